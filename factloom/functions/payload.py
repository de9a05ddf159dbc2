"""Values of unknown type: JSON payloads as VARIANT, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kind_of(schema: Column) -> Column:
    """The answer type that a variant's schema stands for."""
    return (
        F.when(schema.isin("BIGINT", "INT"), "integer")
        .when(schema.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean")
        .when(F.startswith(schema, F.lit("ARRAY")), "list")
        .when(F.startswith(schema, F.lit("OBJECT")), "object")
        .otherwise("null")
    )


def fields(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, field, kind, value): one row for each field of each payload that is a JSON object; others have none.

    Lists and objects are shown as JSON, plain values as text.
    """
    parsed = rows.select(key, F.try_parse_json(payload).alias("_v")).filter(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")))
    each = parsed.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_v").outer())).select(F.col(key), F.col("key").alias("field"), F.col("value").alias("x"))
    kind = kind_of(F.schema_of_variant("x"))
    text = F.when(kind.isin("list", "object"), F.to_json("x")).otherwise(F.try_variant_get("x", "$", "string"))
    return each.select(key, "field", kind.alias("kind"), text.alias("value"))


def filled(found: DataFrame, rows: DataFrame, key: str, defaults: DataFrame) -> DataFrame:
    """``found`` and, for every row and every declared (field, kind, value) it lacks or has as null, the default; ``given`` tells which. ``defaults`` is a schema."""
    wanted = rows.select(key).distinct().join(F.broadcast(defaults.select("field", F.col("kind").alias("dkind"), F.col("value").alias("dvalue"))))
    known = found.select(key, "field", "kind", "value", F.lit(True).alias("given"))
    full = wanted.join(known, [key, "field"], "full")
    has = F.coalesce(F.col("given"), F.lit(False)) & (F.coalesce("kind", F.lit("null")) != "null")
    return full.select(key, "field", F.when(has | F.col("dkind").isNull(), F.col("kind")).otherwise(F.col("dkind")).alias("kind"), F.when(has | F.col("dkind").isNull(), F.col("value")).otherwise(F.col("dvalue")).alias("value"), has.alias("given"))
