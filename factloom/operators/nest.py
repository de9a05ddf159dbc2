"""Nested documents: several child collections of one parent in one shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nested(parents: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Parents with an array of structs for each of ``children``, sorted by the structs' fields.

    Parents and children are united under a tag, each kind in a struct column of its own,
    and meet in one aggregation by ``key``; no join multiplies them. A child's struct has all
    its columns but the key. Children without a parent are left out, a parent without
    children has empty arrays, and parents repeated under one key count once.
    """
    kinds = {"_self": parents, **children}
    packed = {name: df.select(F.col(key), F.struct(*[c for c in df.columns if c != key]).alias(name)) for name, df in kinds.items()}
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), packed.values())
    lists = [F.array_sort(F.collect_list(name)).alias(name) for name in children]  # collect_list leaves nulls out
    rows = every.groupBy(key).agg(F.max(F.when(F.col("_self").isNotNull(), F.col("_self"))).alias("_self"), *lists)
    return rows.filter("_self is not null").select(key, "_self.*", *children)
