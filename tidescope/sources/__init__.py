"""Readers, and the test tables seen as synced tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

USERS = 16


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tbl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Pipe-delimited rows whose last delimiter ends the row."""
    padded = T.StructType([*schema.fields, T.StructField("_end", T.StringType())])
    return spark.read.schema(padded).option("sep", "|").csv(path).drop("_end")


def scope_of_customer(key: Column) -> Column:
    """The tables have no owner: a customer belongs to one of 16 users."""
    return F.concat(F.lit("user:"), (key % USERS).cast("string"))


def surrogate(key: Column) -> Column:
    """A checksum that every SQL engine can repeat, for comparisons."""
    return (key * 2654435761) % 2147483647


def line_id() -> Column:
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    return F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day)


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a change log: (seq, scope_id, table_name, record_id, operation)."""
    op = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", 3).otherwise(2)
    return read(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("seq"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("scope_id"),
        F.lit("items").alias("table_name"), (F.col("event_id") % 200).cast("string").alias("record_id"), op.cast("int").alias("operation"),
    )
