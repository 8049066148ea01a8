"""Tables by name, with explicit types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Columns of the tables that queries use; a file may hold more.
SCHEMAS: dict[str, str] = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}

#: Tables of the two benchmark schemas as their generators write them (fixed values: names, order and types of columns).
TPCH: dict[str, str] = {
    "customer": "c_custkey int, c_name string, c_address string, c_nationkey int, c_phone string, c_acctbal float, c_mktsegment string, c_comment string",
    "part": "p_partkey int, p_name string, p_mfgr string, p_brand string, p_type string, p_size int, p_container string, p_retailprice float, p_comment string",
    "supplier": "s_suppkey int, s_name string, s_address string, s_nationkey int, s_phone string, s_acctbal float, s_comment string",
    "partsupp": "ps_partkey int, ps_suppkey int, ps_availqty int, ps_supplycost float, ps_comment string",
    "orders": "o_orderkey int, o_custkey int, o_orderstatus string, o_totalprice float, o_orderdate date, o_orderpriority string, o_clerk string, o_shippriority int, o_comment string",
    "lineitem": "l_orderkey int, l_partkey int, l_suppkey int, l_linenumber int, l_quantity float, l_extendedprice float, l_discount float, l_tax float, l_returnflag string, l_linestatus string, "
    "l_shipdate date, l_commitdate date, l_receiptdate date, l_shipinstruct string, l_shipmode string, l_comment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int, n_comment string",
    "region": "r_regionkey int, r_name string, r_comment string",
}
STAR: dict[str, str] = {
    "part": "p_partkey int, p_name string, p_mfgr string, p_category string, p_brand1 string, p_color string, p_type string, p_size int, p_container string",
    "supplier": "s_suppkey int, s_name string, s_address string, s_city string, s_nation string, s_region string, s_phone string",
    "customer": "c_custkey int, c_name string, c_address string, c_city string, c_nation string, c_region string, c_phone string, c_mktsegment string",
    "date": "d_datekey int, d_date string, d_dayofweek string, d_month string, d_year int, d_yearmonthnum int, d_yearmonth string, d_daynuminweek int, d_daynuminmonth int, d_daynuminyear int, "
    "d_monthnuminyear int, d_weeknuminyear int, d_sellingseason string, d_lasdayinweekfl string, d_lastdayinmonthfl string, d_holidyfl string, d_weekdayfl string",
    "lineorder": "lo_orderkey int, lo_linenumber int, lo_custkey int, lo_partkey int, lo_suppkey int, lo_orderdate int, lo_orderpriority string, lo_shippriority string, lo_quantity int, lo_extendedprice int, "
    "lo_ordertotalprice int, lo_discount int, lo_revenue int, lo_supplycost int, lo_tax int, lo_commitdate int, lo_shipmode string",
}

#: SQL types and what they are here. All integers are computed as long, all reals as double.
TYPES: dict[str, T.DataType] = {
    "boolean": T.BooleanType(),
    "tinyint": T.ByteType(),
    "smallint": T.ShortType(),
    "integer": T.IntegerType(),
    "bigint": T.LongType(),
    "real": T.FloatType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "varchar": T.StringType(),
    "varbinary": T.BinaryType(),
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[table])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables. No files are opened to learn its types."""
    return spark.read.schema(schema(name)).parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, *names: str) -> None:
    """Temporary views of tables, all known ones if none is named."""
    for name in names or SCHEMAS:
        table(spark, folder, name).createOrReplaceTempView(name)
