"""Scan the driver's parquet tables with fixed schemas (no inference)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_L, _I, _D, _S, _TS = (T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(),
                       T.TimestampNTZType())


def _struct(*pairs):
    return T.StructType([T.StructField(n, t, True) for n, t in pairs])


DRIVER_SCHEMAS: dict[str, T.StructType] = {
    "region": _struct(("r_regionkey", _I), ("r_name", _S)),
    "nation": _struct(("n_nationkey", _I), ("n_name", _S), ("n_regionkey", _I)),
    "customer": _struct(("c_custkey", _L), ("c_name", _S), ("c_nationkey", _I),
                        ("c_acctbal", _D), ("c_mktsegment", _S)),
    "supplier": _struct(("s_suppkey", _L), ("s_name", _S), ("s_nationkey", _I), ("s_acctbal", _D)),
    "part": _struct(("p_partkey", _L), ("p_name", _S), ("p_brand", _S), ("p_type", _S),
                    ("p_size", _I), ("p_retailprice", _D)),
    "orders": _struct(("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S),
                      ("o_totalprice", _D), ("o_orderdate", _TS), ("o_orderpriority", _S)),
    "lineitem": _struct(("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L),
                        ("l_linenumber", _I), ("l_quantity", _D), ("l_extendedprice", _D),
                        ("l_discount", _D), ("l_tax", _D), ("l_returnflag", _S),
                        ("l_linestatus", _S), ("l_shipdate", _TS)),
    "events": _struct(("event_id", _L), ("ts", _TS), ("user_id", _L), ("event_type", _S),
                      ("value", _D), ("props", _S)),
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(DRIVER_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


class DriverTables(dict):
    """Driver tables by name, each read (with its fixed schema) on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        if name not in DRIVER_SCHEMAS:
            raise KeyError(name)
        df = read_table(self.spark, self.sf_dir, name)
        self[name] = df
        return df


def read_driver(spark: SparkSession, sf_dir: str) -> DriverTables:
    """Lazy DataFrames for every driver table the shop model is derived from."""
    return DriverTables(spark, sf_dir)
