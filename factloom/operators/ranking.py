"""Ranked de-duplication, thresholds and greedy packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Confidence names and their ranks.
CONFIDENCE = {"high": 3, "medium": 2, "low": 1, "not_found": 0}


def confidence_rank(c: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])[c], F.lit(0))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in ``order``; the rank filter is pushed below the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def best_answer(answers: DataFrame, question: str = "question_id", confidence: str = "confidence", seq: str = "seq") -> DataFrame:
    """Best confidence a question; the first of equals stays."""
    return first_by(answers, [question], confidence_rank(F.col(confidence)).desc(), F.col(seq).asc())


def best_segment(segments: DataFrame) -> DataFrame:
    """Widest found span a segment id; the later map wins ties, not-found rows only stand in for nothing."""
    span = F.col("end_page") - F.col("start_page")
    return first_by(segments, ["doc_id", "segment_type_id"], F.col("found").desc(), span.desc(), F.col("map_idx").desc())


def last_row(df: DataFrame, keys: list[str], *recency: str) -> DataFrame:
    return first_by(df, keys, *[F.col(c).desc() for c in recency])


def near_top(scores: DataFrame, group: str, score: str = "score", share: float = 0.25, least: float = 1.0) -> DataFrame:
    """Rows with score >= greatest(least, share * best of the group)."""
    best = scores.groupBy(group).agg(F.max(score).alias("_best"))
    return scores.join(best, group).filter(F.col(score) >= F.greatest(F.lit(least), F.col("_best") * share)).drop("_best")


def greedy_batches(items: DataFrame, group: str, key: str, cost: str, budget: float) -> DataFrame:
    """(group, key, batch): items in key order fill batches up to ``budget``; an oversize item stands alone.

    A fold over one group's items, held as an array: a group is the questions of one
    covenant, bounded by the ontology, never a table of facts.
    """
    listed = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col(cost).cast("double").alias("cost")))).alias("items"))
    kind = T.ArrayType(T.StructType([T.StructField("key", dict((f.name, f.dataType) for f in items.schema)[key]), T.StructField("batch", T.IntegerType())]))
    start = F.struct(F.lit(0).alias("batch"), F.lit(0.0).alias("used"), F.lit(None).cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        opens = (acc["used"] > 0) & (acc["used"] + x["cost"] > budget)
        batch = F.when(opens, acc["batch"] + 1).otherwise(acc["batch"])
        used = F.when(opens, x["cost"]).otherwise(acc["used"] + x["cost"])
        row = F.array(F.struct(x["key"].alias("key"), batch.alias("batch"))).cast(kind)
        return F.struct(batch.alias("batch"), used.alias("used"), F.coalesce(F.concat(acc["out"], row), row).alias("out"))

    return listed.select(group, F.inline(F.aggregate("items", start, step, lambda acc: acc["out"]))).select(group, F.col("key").alias(key), "batch")


def first_source(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """All rows of the first source, in the order given, that has any for a key; ``source`` is its number.

    One ranked union and one shuffle by key. Columns that a source lacks are null.
    """
    ranked = [df.withColumn("source", F.lit(i)) for i, df in enumerate(sources)]
    every = ranked[0]
    for df in ranked[1:]:
        every = every.unionByName(df, allowMissingColumns=True)
    best = F.min("source").over(Window.partitionBy(*keys))
    return every.withColumn("_best", best).filter("source = _best").drop("_best")
