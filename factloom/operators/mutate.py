"""Inserts, upserts, replacements and deletes as set algebra on tables.

Tables are write-once: a mutation is the DataFrame of the table afterwards, or of
the rows to append.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut


def new_rows(candidates: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose key is not there yet, one a key."""
    return candidates.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def insert_if_absent(existing: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    return existing.unionByName(new_rows(candidates, existing, keys), allowMissingColumns=True)


def put(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Upsert that inserts only where no identical row exists."""
    return insert_if_absent(existing, candidates, existing.columns)


def first_write_wins(writes: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Attribute writes on a 0..1 attribute: later ones are rejected."""
    rest = [c for c in writes.columns if c not in keys]
    return writes.groupBy(*keys).agg(F.min(F.struct(seq, *[c for c in rest if c != seq])).alias("w")).select(*keys, "w.*").select(*writes.columns)


def default_if_unset(df: DataFrame, lookup: DataFrame, on: str, column: str, default: str) -> DataFrame:
    return df.join(lookup, on, "left").withColumn(column, F.coalesce(column, default)).drop(default)


def delete_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_anti")


def delete_like(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose id matches the whole regular expression go; null ids stay."""
    return df.filter(~F.coalesce(F.col(column).rlike(f"^(?:{pattern})$"), F.lit(False)))


def replace_attribute(base: DataFrame, updates: DataFrame, on: str, column: str) -> DataFrame:
    new = updates.select(on, F.col(column).alias("_new"))
    return base.join(new, on, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def cascade_delete(tables: dict[str, DataFrame], deal_ids: DataFrame, keep_entities: bool = True) -> dict[str, DataFrame]:
    """Tables after deleting deals: answers, applicability, provisions, deals; entities only if asked for."""
    doomed = tables["provisions"].join(deal_ids, "deal_id", "left_semi").select("provision_id")
    out = dict(tables)
    for name in ("answers", "applicability", "provisions", *([] if keep_entities else ["entities"])):
        if name in out:
            out[name] = out[name].join(doomed, "provision_id", "left_anti")
    out["deals"] = out["deals"].join(deal_ids, "deal_id", "left_anti")
    return out


def business_id(prefix: str, *columns: str) -> Column:
    """A repeatable id from a business key."""
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256).substr(1, 16))


def layers(holds: DataFrame) -> list[list[str]]:
    """Types in layers, holders before what they hold, from (holder_type, held_type) pairs; a cycle raises ValueError.

    The pairs are those of a schema, so they come to the driver.
    """
    pairs = {(a, b) for a, b in holds.select("holder_type", "held_type").distinct().collect() if a is not None and b is not None}
    left, out = {t for pair in pairs for t in pair}, []
    while left:
        free = sorted(left - {b for _, b in pairs})
        if not free:
            raise ValueError(f"types hold each other: {sorted(left)}")
        out.append(free)
        left -= set(free)
        pairs = {(a, b) for a, b in pairs if a in left}
    return out


def held_below(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(type, id, step) of the roots and of everything they hold, over any number of hops; steps count from what is deleted first.

    ``links`` has holder_type, holder, held_type and held; ``roots`` type and id. The order of
    the types is read from the links. One join a layer; a layer's new ids are written before the
    next one joins them, and those of earlier layers are not written again.
    """
    order = layers(links)
    depth = {t: i for i, types in enumerate(order) for t in types}
    doomed = cut(roots.select("type", "id").distinct())
    for types in order[1:]:
        below = links.filter(F.col("held_type").isin(*types)).join(doomed, (F.col("holder_type") == F.col("type")) & (F.col("holder") == F.col("id")), "left_semi")
        # Ids of these types come from this layer and the roots only.
        listed = doomed.filter(F.col("type").isin(*types))
        doomed = doomed.union(cut(below.select(F.col("held_type").alias("type"), F.col("held").alias("id")).distinct().join(listed, ["type", "id"], "left_anti")))
    step = F.create_map(*[F.lit(x) for t, i in depth.items() for x in (t, len(order) - i)]) if depth else F.create_map()
    return doomed.withColumn("step", F.coalesce(step[F.col("type")], F.lit(len(order) + 1)) if depth else F.lit(1))


def bottom_up_delete(nodes: DataFrame, links: DataFrame, roots: DataFrame, keep_roots: bool = False) -> tuple[DataFrame, DataFrame]:
    """(survivors, deleted with their step): what the roots hold goes, leaves first; the roots go last, or stay."""
    doomed = held_below(links, roots)
    if keep_roots:
        doomed = doomed.join(roots.select("type", "id"), ["type", "id"], "left_anti")
    # Survivors need not know which of the doomed are there, so nodes are made once for them.
    return nodes.join(doomed, ["type", "id"], "left_anti"), doomed.join(nodes.select("type", "id"), ["type", "id"], "left_semi")


def multiset_difference(expected: DataFrame, stored: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys, missing, extra, surplus): two lists a key held against each other, repeats counted.

    ``missing`` and ``extra`` are sorted arrays of items that only one side has; ``surplus``
    is an array of (item, n) for items of both, n more (or, negative, fewer) times stored.
    One aggregate over the union of both sides; null items are left out.
    """
    side = lambda df, a, b: df.select(*keys, F.col(item).alias("item"), F.lit(a).alias("e"), F.lit(b).alias("s"))
    counted = side(expected, 1, 0).unionByName(side(stored, 0, 1)).groupBy(*keys, "item").agg(F.sum("e").alias("e"), F.sum("s").alias("s"))
    e, s = F.col("e"), F.col("s")
    listed = lambda c, x: F.array_sort(F.collect_list(F.when(c & F.col("item").isNotNull(), x)))
    return counted.groupBy(*keys).agg(
        listed(s == 0, F.col("item")).alias("missing"), listed(e == 0, F.col("item")).alias("extra"), listed((e > 0) & (s > 0) & (e != s), F.struct("item", (s - e).alias("n"))).alias("surplus")
    )
