"""Scratch tables in the cluster's shared folder, used to cut lineage between passes.

The folder is ``spark.checkpoint.dir`` of the session. Only where that is unset (tests, a
single-JVM master) a temporary folder of this machine is used; on a cluster an unset folder is
an error, because executors do not share local disks. A written table survives lost executors,
and its known size lets Catalyst decide on broadcasting by ``autoBroadcastJoinThreshold``.

Folders are named by application, so what a driver that died has left behind can be told from what
is in use. An operator drops all tables but those its result reads (``keep``); whoever has written
a result drops those too (``released``).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_LEFT: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="blockatlas-")
    return "file://" + _LOCAL["dir"]


def delete_path(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


class Scratch:
    """A private folder for one operator run; dropped tables go at once, the rest at exit."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/blockatlas/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
        self._saved: set[str] = set()
        _LEFT.append((spark, self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        self._saved.add(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete_path(self.spark, self.path(name))
            self._saved.discard(name)

    def keep(self, *names: str) -> None:
        """Drop all tables but these."""
        self.drop(*(self._saved - set(names)))


@contextmanager
def released() -> Iterator[None]:
    """Folders made inside are deleted at the end: for code that writes the results of what it calls."""
    first = len(_LEFT)
    yield
    for spark, root in _LEFT[first:]:
        delete_path(spark, root)
    del _LEFT[first:]


@atexit.register
def _clear_left() -> None:
    for spark, root in _LEFT:
        try:
            delete_path(spark, root)
        except Exception:  # noqa: BLE001 - the JVM may be gone already; nothing else to do at exit
            return
