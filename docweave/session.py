"""Settings that the library reads from the session, and never from the machine."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def share_code(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it runs from a source tree.

    On a cluster the package is installed or passed with ``--py-files``; from a
    checkout the workers need the checkout's folder on their path.
    """
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of this machine only for a local master that names none (tests)."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="docweave-"))
    return context._jsc.sc().getCheckpointDir().get()


#: Folders stored within each open ``scratch`` of this thread.
_open = threading.local()


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder, which the ``scratch`` around removes."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    for folders in getattr(_open, "stack", [])[-1:]:
        folders.append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Write a table as Parquet into the shared folder and read it back.

    For tables that are read several times: the files are compressed and columns that a
    reader doesn't need are not read.  They stay until the ``scratch`` around ends or, without
    one, until the folder is cleared.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table, as loops need it at each turn.

    A written table: unlike a checkpoint's, its size is that of its files, so Spark broadcasts small
    ones, and its estimates don't multiply from turn to turn.
    """
    return stored(df)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored within is removed at the end: for jobs whose result is written before that."""
    stack = _open.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            remove(spark, path)


def stored_in_turn(spark: SparkSession, makes: list[Callable[[], DataFrame]]) -> DataFrame:
    """The tables that ``makes`` plan as one, written one after the other; what each stored on the way is removed before the next."""
    path = new_folder(spark)
    for make in makes:
        with scratch(spark):
            made = make()
            made.write.mode("append").parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def kept(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` plans, written to ``path`` and read back; what it stored on the way is removed."""
    with scratch(spark):
        made = make()
        made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)
