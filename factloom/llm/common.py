"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MEMORY: dict[str, dict] = {}


def memory(name: str) -> dict:
    """What a Python worker remembers for one operator; what it held for others is given up, since workers live on from stage to stage."""
    for other in [k for k in _MEMORY if k != name]:
        del _MEMORY[other]
    return _MEMORY.setdefault(name, {})


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session; where it is unset, a folder
    of our own is used on a local master (tests), and an error is raised on a cluster.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, set where it was not."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir is not set")
            folder = tempfile.mkdtemp(prefix="ckpt")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a table that is not needed any more, in whatever store Spark has it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
