"""Writers and readers of side tables: rows added, JSON rows, listings of files by name.

All of them go through Spark's own readers and writers, so any store that Spark
knows will do. A null or empty table writes an empty folder of its schema. Tables that
others read meanwhile are written to a fresh folder and published (``snapshots``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshots import Snapshots, root_of


def table(spark: SparkSession, name: str) -> Snapshots:
    return Snapshots(spark, root_of(spark, name))


def append_rows(df: DataFrame, path: str, fresh: bool = False) -> None:
    """Rows added to a Parquet folder (``fresh`` starts it anew)."""
    df.write.mode("overwrite" if fresh else "append").parquet(path)


def save_json(df: DataFrame, path: str) -> None:
    """One JSON document a row; an older state of the folder goes."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON table; lines that are no JSON give nulls instead of an error."""
    return spark.read.schema(schema).json(path)


def newest(spark: SparkSession, path: str, limit: int = 20, prefix: str = "") -> DataFrame:
    """(place, name, files, bytes) of the newest results below a folder, whose names hold their time; from the files' metadata, contents are not read.

    A result is a partition ``name=...``, or a file of its own; the last names come first.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    own = F.coalesce(F.nullif(F.regexp_extract("path", "/name=([^/]+)/", 1), F.lit("")), F.substring_index("path", "/", -1))
    named = files.withColumn("name", own).filter(F.startswith("name", F.lit(prefix)))
    return last_names(named.groupBy("name").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")), limit)


def save_results(results: DataFrame, table: Snapshots) -> str:
    """Results (name, ...) saved together, in order of their names; gives the folder.

    Many results share a file: a file each would cost the store a creation and a renaming a
    result, one after another on the driver.
    """
    return table.write(results.repartitionByRange("name").sortWithinPartitions("name"))


def newest_saved(spark: SparkSession, folder: str, limit: int = 20, prefix: str = "") -> DataFrame:
    """(place, name, files) of the newest results that ``save_results`` left; their contents are not read."""
    saved = spark.read.parquet(folder).select("name", F.col("_metadata.file_path").alias("path")).filter(F.startswith("name", F.lit(prefix)))
    return last_names(saved.groupBy("name").agg(F.count_distinct("path").alias("files")), limit)


def last_names(named: DataFrame, limit: int) -> DataFrame:
    """(place, name, ...): the ``limit`` last rows by name, numbered from 1."""
    top = named.orderBy(F.desc("name")).limit(limit)
    # At most ``limit`` rows are numbered.
    return top.agg(F.sort_array(F.collect_list(F.struct(*named.columns)), asc=False).alias("all")).select(F.posexplode("all").alias("place", "x")).select((F.col("place") + 1).alias("place"), "x.*")
