"""Tables, feature sets and rows that the queries share, and their registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.features import FeatureSet, exploded, ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE = ["l_orderkey", "l_linenumber"]


def lines(spark: SparkSession, sf_dir: str) -> FeatureSet:
    """lineitem as features: loc {qty, price, disc, tax}, flag, status, ship and due (dates)."""
    t = table(spark, sf_dir, "lineitem")
    flat = t.select(
        *LINE, F.col("l_quantity").alias("loc_qty"), F.col("l_extendedprice").alias("loc_price"), F.col("l_discount").alias("loc_disc"), F.col("l_tax").alias("loc_tax"),
        F.col("l_returnflag").alias("flag_RAW"), F.col("l_linestatus").alias("status_RAW"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_RAW"),
        F.date_format(F.date_add("l_shipdate", 30), "yyyy-MM-dd").alias("due_RAW"),
    )
    return ingest(flat, LINE)


def string_rows(fs: FeatureSet, family: str, ids: list[str] = LINE) -> DataFrame:
    return exploded(fs.df, ids, fs.strings(family), "feature")


def float_rows(fs: FeatureSet, family: str, ids: list[str] = LINE) -> DataFrame:
    return exploded(fs.df, ids, fs.floats(family), "feature", "value")


def dense_rows(fs: FeatureSet, name: str, ids: list[str] = LINE) -> DataFrame:
    return exploded(fs.df, ids, fs.dense(name), "value", at="pos")
