"""Columnar files, appends and result output."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, schema: StructType | str | None = None, where: Column | None = None, columns: list[str] | None = None, kind: str = "parquet") -> DataFrame:
    """A scan of Parquet, ORC or JSON files with its predicate and columns."""
    df = (spark.read.schema(schema) if schema is not None else spark.read).format(kind).load(path)
    df = df if where is None else df.where(where)
    return df if columns is None else df.select(*columns)


def append(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    df.write.mode("append").format(kind).partitionBy(*(partition_by or [])).save(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    df.write.mode(mode).format(kind).partitionBy(*(partition_by or [])).save(path)


def as_text(row: Row) -> str:
    """A row of values of any type as text: cells between commas, null as NULL."""
    return ",".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in row)


def consume(df: DataFrame, consumer: Callable[[Row], None]) -> int:
    """Hands rows to a consumer on the driver one after another, a partition at a time; gives their number."""
    n = 0
    for row in df.toLocalIterator(prefetchPartitions=True):
        consumer(row)
        n += 1
    return n


def printed(df: DataFrame) -> Iterator[str]:
    return (as_text(r) for r in df.toLocalIterator(prefetchPartitions=True))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder spark.checkpoint.dir; without one in a folder of this machine, on a local master alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        own = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, own, True)
        folder = f"file://{own}"
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}/{name}"
