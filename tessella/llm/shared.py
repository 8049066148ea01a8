"""What the operators share: the folder that all machines see, and written tables that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Paths of the tables that are written and not removed so far, by application.
_tables: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, a folder of our own, on a local master alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return f"file://{_own['dir']}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends, and lost executors cost no more than a rerun of tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    application = spark.sparkContext.applicationId
    if application not in _tables:
        _tables[application] = []
        atexit.register(_at_exit, spark)
    _tables[application].append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._tessella_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes tables that written() gave, once nothing reads them any more."""
    for table in tables:
        removed(table.sparkSession, [table._tessella_path])


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that written() made."""
    of = _tables.get(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        if path in of:
            of.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are written inside go at the end, but those that what it gives is called with."""
    before, stay = set(_tables.get(spark.sparkContext.applicationId, [])), set()

    def keep(table: DataFrame) -> DataFrame:
        stay.add(table._tessella_path)
        return table

    yield keep
    removed(spark, [p for p in _tables.get(spark.sparkContext.applicationId, []) if p not in before | stay])


def _at_exit(spark: SparkSession) -> None:
    """Results are lazy, so tables beneath them stay until the application ends."""
    try:
        removed(spark, list(_tables.get(spark.sparkContext.applicationId, [])))
    except Exception:  # the session is gone: the folder is its owner's to clean
        pass


def spare(df: DataFrame, name: str) -> str:
    """The name, with underscores before it if df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name
