"""Tables that are loaded again once they are too old.

What was loaded lies in a published snapshot, so that all drivers share it and an executor's
loss does not load it anew. Where a reload fails, the rows of the last one are served.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .snapshots import Snapshots

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Kept:
    """``load``'s rows, for ``seconds`` after they were loaded (None: until ``forget``).

    Defined results: a failing load serves the rows from before, however old, and raises
    where there are none (never loaded, or forgotten). An empty load is kept as empty. Of
    several drivers that reload at once, the one that publishes last is read.
    """

    table: Snapshots
    load: Callable[[], DataFrame]
    seconds: float | None = None

    def read(self) -> DataFrame:
        last = self.table.last()
        if last is None or (self.seconds is not None and time.time_ns() - last[0] > self.seconds * 1e9):
            try:
                last = time.time_ns(), self.table.write(self.load())
            except Exception as e:
                if last is None:
                    raise
                log.warning("reload of %s failed, older rows are served: %s", self.table.root, e)
        return self.table.spark.read.parquet(last[1])

    def forget(self) -> None:
        """The next read loads, and has no older rows to serve."""
        self.table.clear()
