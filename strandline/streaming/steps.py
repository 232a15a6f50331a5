"""Steps over folders that are either done or not: planned beside the tables first, then carried out as often as need be."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Steps:
    """A folder whose changes are planned in ``plan/<name>``, marked as ready, carried out by ``_finish`` and taken away.

    ``_finish`` may run again after it was cut short, so all that it does gives the same the second time.
    """

    #: Seconds after which a lock counts as left behind.
    LEASE = 900

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")  # noqa: SLF001
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())  # noqa: SLF001

    def _there(self, name: str) -> bool:
        path, fs = self._path(name)
        return fs.exists(path)

    def _names(self, name: str) -> list[str]:
        path, fs = self._path(name)
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def _touch(self, name: str) -> bool:
        path, fs = self._path(name)
        fs.mkdirs(path.getParent())
        return fs.createNewFile(path)

    def _delete(self, name: str) -> None:
        path, fs = self._path(name)
        fs.delete(path, True)

    @contextmanager
    def _alone(self) -> Iterator[None]:
        """One step at a time, over all processes that share the folder."""
        path, fs = self._path("lock")
        while not self._touch("lock"):
            try:
                if time.time() - fs.getFileStatus(path).getModificationTime() / 1000 > self.LEASE:
                    fs.delete(path, False)
                    continue
            except Exception:  # noqa: BLE001, S110  the lock went meanwhile
                continue
            time.sleep(0.2)
        try:
            yield
        finally:
            fs.delete(path, False)

    def name_of(self, kind: str, batch: DataFrame) -> str:
        """Name of the step of a batch: its number of rows and two sums of their hashes, whatever their order."""
        line = F.struct(*batch.columns)
        h = lambda *seed: F.coalesce(F.sum(F.xxhash64(*seed, line).cast("decimal(38,0)")), F.lit(0))
        told = batch.agg(F.count("*").alias("n"), h().alias("a"), h(F.lit(1)).alias("b")).first()
        return f"{kind}-{told.n}-{told.a}-{told.b}"

    def _recover(self) -> None:
        """Finish the steps that were cut short, and forget plans that never became ready."""
        for name in self._names("plan"):
            if self._there(f"plan/{name}/ready"):
                self._finish(name)
            else:
                self._delete(f"plan/{name}")

    def _finish(self, name: str) -> None:
        raise NotImplementedError
