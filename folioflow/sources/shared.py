"""Written tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder name below the session's ``spark.checkpoint.dir``, removed when the driver ends, or at the end of a ``scratch`` block around it unless ``keep``.

    A setting is made only where there is none and the master is local, as in tests.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="folioflow-")
        spark.conf.set(CHECKPOINT_DIR, base)
    path = f"{base.rstrip('/')}/folioflow-{uuid.uuid4().hex}-{name}"
    atexit.register(_remove, spark, path)
    if _scopes and not keep:
        _scopes[-1].append(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; the folder is left to the cluster's cleaning
        pass


def written(df: DataFrame, name: str, keep: bool = False, file_rows: int = 0) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: the lineage is cut and survives lost executors. ``file_rows``: the most rows of a file."""
    path = shared_dir(df.sparkSession, name, keep)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes tables that ``written`` returned and that nothing reads any more."""
    for df in tables:
        if path := _paths.pop(df, None):
            _remove(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was written inside, but for tables with ``keep``."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _remove(spark, path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many more underscores as make it none of the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
