"""Tables that cut lineage, kept in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset, and only on a local
master (tests), a temporary folder takes its place; on a cluster an unset folder is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders that are there, for the end of the process; and, for each thread, those of the blocks that it is in.
_MADE: dict[str, SparkSession] = {}
_OPEN = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="strandline-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


class Scratch:
    """Written tables of one query; ``drop`` removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/strandline-{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        if not _MADE:
            atexit.register(_sweep)
        _MADE[self.root] = spark
        for block in getattr(_OPEN, "blocks", ()):
            block.append(self.root)

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it as read back from the written files."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # noqa: SLF001
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, t._scratch_path)  # noqa: SLF001


@contextmanager
def released() -> Iterator[None]:
    """Drop on the way out, by an error too, all tables that scratches made inside by this thread have written: for a step whose result has been written elsewhere by then."""
    mine: list[str] = []
    _OPEN.blocks = [*getattr(_OPEN, "blocks", ()), mine]
    try:
        yield
    finally:
        _OPEN.blocks = _OPEN.blocks[:-1]
        for root in mine:
            spark = _MADE.pop(root, None)
            if spark is not None:
                _delete(spark, root)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)  # noqa: SLF001


def _sweep() -> None:
    """At exit: remove what is left, where the session still answers."""
    for path, spark in list(_MADE.items()):
        try:
            if spark._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():  # noqa: SLF001
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone
            return
