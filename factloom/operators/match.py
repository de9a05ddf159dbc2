"""Graph-pattern steps as joins: hop, optional, without, exists, links.

All are equi-joins on ids, so Catalyst picks broadcast or sort-merge, and adaptive
execution splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hop(left: DataFrame, edges: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """left -edge-> right; ``edges`` has both id columns."""
    return left.join(edges, left_id).join(right, right_id)


def either_way(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges in both role orders, for patterns with anonymous roles."""
    return edges.unionByName(edges.select(*[F.col(b if c == a else a if c == b else c).alias(c) for c in edges.columns]))


def optional(left: DataFrame, right: DataFrame, on: list[str] | str) -> DataFrame:
    """``try``: missing partners leave nulls."""
    return left.join(right, on, "left")


def without(left: DataFrame, right: DataFrame, on: list[str] | str) -> DataFrame:
    """``not``: rows of ``left`` with no partner."""
    return left.join(right, on, "left_anti")


def having(left: DataFrame, right: DataFrame, on: list[str] | str) -> DataFrame:
    return left.join(right, on, "left_semi")


def checked(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name boolean): whether each row of ``left`` has a partner."""
    found = right.select(key).distinct().withColumn("_found", F.lit(True))
    return left.select(key).join(found, key, "left").select(key, F.coalesce("_found", F.lit(False)).alias(name))


def links(players: DataFrame, excluded: list[str], rel: str = "rel_id", slot: str = "slot", player: str = "player_id", kind: str = "rel_type") -> DataFrame:
    """Ordered pairs of different players of one relation, without the excluded relation families.

    A relation has a handful of players, so the self-join grows with the edges.
    """
    kept = players.filter(~F.col(kind).isin(*excluded)) if excluded else players
    mine = kept.select(rel, kind, F.col(slot).alias("my_slot"), F.col(player).alias("entity_id"))
    theirs = kept.select(rel, F.col(slot).alias("their_slot"), F.col(player).alias("linked_id"))
    return mine.join(theirs, rel).filter("my_slot <> their_slot")


def reachable(edges: DataFrame, source: str, target: str, max_depth: int) -> DataFrame:
    """(source, target, depth): least number of hops, up to ``max_depth``; each round keeps new pairs only."""
    step = edges.select(F.col(source).alias("s"), F.col(target).alias("t")).distinct()
    found = level = step.withColumn("depth", F.lit(1))
    for depth in range(2, max_depth + 1):
        more = level.alias("l").join(step.alias("e"), F.col("l.t") == F.col("e.s")).select(F.col("l.s").alias("s"), F.col("e.t").alias("t")).distinct()
        level = more.join(found, ["s", "t"], "left_anti").withColumn("depth", F.lit(depth))
        found = found.unionByName(level)
    return found.select(F.col("s").alias(source), F.col("t").alias(target), "depth")


def strict_sum(a: DataFrame, b: DataFrame, key: str, left: Column, right: Column, name: str) -> DataFrame:
    """key, left + right; absent where either is (no default of zero)."""
    return a.join(b, key).select(key, (left + right).alias(name))
