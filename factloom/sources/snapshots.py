"""Side tables as published snapshots.

Data is written to a fresh folder that nothing ever overwrites; a table's state is the
log of its publications. A publication is one empty marker file whose name holds its time,
its kind and the folder: a ``replace`` starts the table anew, an ``append`` adds to it,
a ``clear`` (with the folder ``none``) leaves it without rows.
Markers of different writers never collide, so no publication is lost, and a reader lists
the log and reads the folders that are live. What a DataFrame reads stays in place until
``drop_older`` is asked to remove it.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from .shared import checkpoint_folder


def root_of(spark: SparkSession, name: str) -> str:
    """The table's place: in the warehouse, or in the checkpoint folder where no warehouse was named; driver and executors share both."""
    named = spark.sparkContext.getConf().get("spark.sql.warehouse.dir") or spark.conf.get("spark.sql.catalogImplementation", "") == "hive"
    base = spark.conf.get("spark.sql.warehouse.dir") if named else checkpoint_folder(spark)
    return f"{base.rstrip('/')}/factloom_files/{name}"


@dataclass(frozen=True)
class Snapshots:
    """One table: its publications and readers."""

    spark: SparkSession
    root: str

    @cached_property
    def _hadoop(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm.org.apache.hadoop.fs.Path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _log(self) -> list[tuple[str, str, str]]:
        """(marker, kind, folder) by time."""
        make, fs = self._hadoop
        place = make(f"{self.root}/_log")
        names = sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []
        return [(n, *n.split(".", 2)[1:]) for n in names if n.count(".") == 2]

    def fresh(self) -> str:
        """A new folder for data that is not yet published."""
        return f"{self.root}/data/{uuid.uuid4().hex}"

    def publish(self, folder: str, kind: str = "replace") -> None:
        """Makes a written folder part of the table."""
        make, fs = self._hadoop
        fs.create(make(f"{self.root}/_log/{time.time_ns():020d}.{kind}.{folder.rsplit('/', 1)[-1]}"), False).close()

    def live(self) -> list[str]:
        """Folders of the table as it is now: from the last replacement on."""
        out: list[str] = []
        for _, kind, folder in self._log():
            out = [] if kind == "clear" else [folder] if kind == "replace" else [*out, folder]
        return [f"{self.root}/data/{f}" for f in out]

    def last(self) -> tuple[int, str] | None:
        """Time (nanoseconds) and folder of the last publication, unless the table was cleared since."""
        marker, kind, folder = (self._log() or [("", "clear", "")])[-1]
        return None if kind == "clear" else (int(marker.split(".")[0]), f"{self.root}/data/{folder}")

    def clear(self) -> None:
        self.publish("none", "clear")

    def write(self, df: DataFrame, kind: str = "replace", form: str = "parquet", partitions: tuple[str, ...] = (), **options: str) -> str:
        """Writes and publishes; gives the folder, whose rows are this publication's own."""
        folder = self.fresh()
        df.write.partitionBy(*partitions).options(**options).format(form).save(folder)
        self.publish(folder, kind)
        return folder

    def read(self, schema: str, form: str = "parquet") -> DataFrame:
        """Rows of the table as it is now; none where nothing was published."""
        paths = self.live()
        return self.spark.read.schema(schema).format(form).load(paths) if paths else self.spark.createDataFrame([], schema)

    def drop_older(self, keep: int = 1) -> int:
        """Removes what the last ``keep`` replacements have left behind; gives the number of folders removed. Frames that still read them fail from then on."""
        make, fs = self._hadoop
        log = self._log()
        starts = [i for i, (_, kind, _) in enumerate(log) if kind == "replace"]
        old = log[: starts[-keep]] if len(starts) >= keep > 0 else []
        for marker, _, folder in old:
            fs.delete(make(f"{self.root}/data/{folder}"), True)
            fs.delete(make(f"{self.root}/_log/{marker}"), False)
        return len(old)
