"""Portable seeds: what a client starts from without having pulled, as tables in one folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidescope.functions.types import SPARK, STORAGE


def manifest(shared: DataFrame, edges: DataFrame) -> DataFrame:
    """(scope_id, members, checksum) of every portable scope that has members."""
    mine = edges.join(shared.filter("portable").select("scope_id"), "scope_id", "left_semi")
    return mine.groupBy("scope_id").agg(F.count("*").alias("members"), F.coalesce(F.bit_xor("checksum"), F.lit(0)).alias("checksum"))


def rows(shared: DataFrame, edges: DataFrame, present: DataFrame) -> DataFrame:
    """The live rows of portable scopes: scope_id and the columns of ``present`` (table_name, record_id, row_json, row_version, deleted)."""
    mine = edges.join(shared.filter("portable").select("scope_id"), "scope_id", "left_semi").select("scope_id", "table_name", "record_id", F.col("checksum").alias("edge_checksum"))
    return mine.join(present.filter("not deleted"), ["table_name", "record_id"])


def stored(value: Column, portable: str) -> Column:
    """Text as the storage class of its portable type: whole numbers, reals, text or bytes. A fraction where a whole number belongs is an error, as is text
    that is no number; a boolean becomes 0 or 1."""
    if STORAGE[portable] == "INTEGER" and portable != "boolean":
        number = value.try_cast("decimal(38,18)")
        whole = F.when(number == F.floor(number), number.cast("long"))
        return F.when(value.isNotNull() & whole.isNull(), F.raise_error(F.concat(F.lit("not a whole number: "), value))).otherwise(whole)
    if portable == "boolean":
        flag = F.when(F.lower(value).isin("true", "t", "1"), 1).when(F.lower(value).isin("false", "f", "0"), 0).cast("long")
        return F.when(value.isNotNull() & flag.isNull(), F.raise_error(F.concat(F.lit("not a boolean: "), value))).otherwise(flag)
    if STORAGE[portable] == "REAL":
        real = value.try_cast("double")
        return F.when(value.isNotNull() & real.isNull(), F.raise_error(F.concat(F.lit("not a number: "), value))).otherwise(real)
    return F.unbase64(value) if portable == "bytes" else value


def check(columns: DataFrame, given: tuple[int, str], local: tuple[int, str]) -> None:
    """Raise where a manifest has an unknown type or no key, or is not of the schema version and hash that the seed is for."""
    if given != local:
        raise ValueError(f"the manifest is of schema {given}, the seed of {local}")
    wrong = columns.filter(~F.col("portable_type").isin(*SPARK)).limit(5).collect()
    if wrong:
        raise ValueError(f"unsupported types: {[tuple(r) for r in wrong]}")
    bare = columns.groupBy("table_name").agg(F.max(F.col("is_key").cast("int")).alias("keys")).filter("keys = 0").limit(5).collect()
    if bare:
        raise ValueError(f"no key in {[r['table_name'] for r in bare]}")


def export(folder: str, columns: DataFrame, shared: DataFrame, edges: DataFrame, present: DataFrame, schema: tuple[int, str], overwrite: bool = False) -> None:
    """Write a seed: a table for each synced table that portable scopes have rows of, who holds them (``scope_rows``), and ``metadata``.

    ``columns``: table_name, column_name, portable_type, is_key in order of position. An existing seed is an error unless ``overwrite``. Every table is taken
    from the inputs as they are when the call begins; pass stored tables for one snapshot.
    """
    mode = "overwrite" if overwrite else "errorifexists"
    spark = columns.sparkSession
    check(columns, schema, schema)
    found = rows(shared, edges, present)
    listed: dict[str, list] = {}
    for r in columns.orderBy("table_name", "position").collect():  # a row for each synced column
        listed.setdefault(r["table_name"], []).append((r["column_name"], r["portable_type"]))
    sums = manifest(shared, edges)
    note = spark.range(1).select(F.lit(schema[0]).alias("schema_version"), F.lit(schema[1]).alias("schema_hash"), F.lit(int(not shared.filter("portable").isEmpty())).alias("snapshot_complete"))
    note.write.mode(mode).parquet(f"{folder}/metadata")
    sums.write.mode(mode).parquet(f"{folder}/scopes")
    found.select("scope_id", "table_name", "record_id", F.col("edge_checksum").alias("checksum")).write.mode(mode).parquet(f"{folder}/scope_rows")
    for name, own in listed.items():
        values = F.from_json("row_json", "map<string,string>")
        one = found.filter(F.col("table_name") == name).dropDuplicates(["record_id"]).withColumn("v", values)
        one.select(*[stored(F.col("v")[c], t).alias(c) for c, t in own]).write.mode(mode).parquet(f"{folder}/{name}")


def local_tables(columns: DataFrame) -> DataFrame:
    """(table_name, ddl) of a client's tables: each column with its storage class, the key marked."""
    storage = F.create_map(*[F.lit(x) for pair in STORAGE.items() for x in pair])
    line = F.concat(F.lit("`"), F.replace("column_name", F.lit("`"), F.lit("``")), F.lit("` "), storage[F.col("portable_type")], F.when(F.col("is_key"), " PRIMARY KEY").otherwise(""))
    per = columns.groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("lines"))
    return per.select("table_name", F.concat(F.lit("CREATE TABLE `"), "table_name", F.lit("` ("), F.array_join(F.transform("lines", lambda x: x["line"]), ", "), F.lit(")")).alias("ddl"))
