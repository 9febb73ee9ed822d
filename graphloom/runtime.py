"""Session helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="graphloom-"), "graphloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.join("graphloom", os.path.relpath(os.path.join(d, n), root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where that is unset, a temporary one with a local master; an error with any other."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", root)
        _made.append(root)
    return root.rstrip("/")


@atexit.register
def _forget() -> None:
    for d in _made:
        shutil.rmtree(d.removeprefix("file://"), ignore_errors=True)


_written: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder, which ``forget`` or the ``passing`` around it deletes."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    _written.append(path)
    return path


def store(df: DataFrame, label: str = "graphs") -> DataFrame:
    """Written to the shared folder and read again, so that it runs once and a lost executor costs no lineage."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def written() -> int:
    """How many stored tables there are: a place to ``forget`` from."""
    return len(_written)


def forget(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Deletes what ``store`` wrote, from the ``since``-th table on, but for the tables that ``keep`` reads. Lazy results that still read others fail after that."""
    held = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for d in keep for f in d.inputFiles()}
    jvm = spark.sparkContext._jvm
    for path in [p for p in _written[since:] if p.rsplit("/", 1)[-1] not in held]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _written.remove(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables stored inside go at its end, but for those that a table put into the list reads."""
    since, keep = written(), []
    yield keep
    forget(spark, since, tuple(keep))
