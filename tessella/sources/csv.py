"""CSV files with stated types; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str, delimiter: str = ",", quote: str = '"', escape: str = '"', null_string: str = "", header: bool = False, multi_line: bool = False) -> DataFrame:
    """Rows of CSV files. A last line without a line end counts. ``multi_line`` is for cells that hold line ends; such files can't be split."""
    return spark.read.schema(schema).options(sep=delimiter, quote=quote, escape=escape, nullValue=null_string, header=header, multiLine=multi_line, mode="FAILFAST").csv(path)


def bulk_load(spark: SparkSession, folder: str, table: str, schema: StructType | str) -> DataFrame:
    r"""``<folder>/<table>.csv`` as bulk loaders write it: cells between ``|``, and ``\N`` for null."""
    return read_csv(spark, f"{folder}/{table}.csv", schema, delimiter="|", null_string="\\N")


def load_all(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a benchmark's schemas (catalog.TPCH or catalog.STAR) from a folder of files for bulk loaders."""
    return {name: bulk_load(spark, folder, name, schema) for name, schema in schemas.items()}


def write_csv(df: DataFrame, path: str, delimiter: str = ",", null_string: str = "", mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(sep=delimiter, nullValue=null_string, quote='"', escape='"').csv(path)


def to_text(*columns: str, delimiter: str = ",", null_string: str = "") -> Column:
    """The CSV line of some columns."""
    return F.to_csv(F.struct(*columns), {"sep": delimiter, "nullValue": null_string, "quote": '"', "escape": '"'})


def from_text(df: DataFrame, line: str, schema: str, delimiter: str = ",", null_string: str = "") -> DataFrame:
    """Columns parsed from a column of CSV lines."""
    return df.select(F.from_csv(line, schema, {"sep": delimiter, "nullValue": null_string, "quote": '"', "escape": '"', "mode": "FAILFAST"}).alias("cells")).select("cells.*")
