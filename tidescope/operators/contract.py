"""What a request or a response must fulfil, checked for whole tables of them: each check adds ``violation``, null where all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidescope.functions.types import EXACT


def is_timestamp(text: Column) -> Column:
    """Whether trimmed text is an RFC 3339 time with its offset."""
    trimmed = F.trim(text)
    shape = trimmed.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    return shape & F.try_to_timestamp(F.upper(trimmed)).isNotNull()


def deltas(table: DataFrame) -> DataFrame:
    """``table`` with arrays ``add`` and ``remove`` of scopes."""
    add, remove = F.col("add"), F.col("remove")
    empty = lambda a: F.array_contains(a, "")
    twice = lambda a: F.size(F.array_distinct(a)) < F.size(a)
    kind = (
        F.when(empty(add), "empty_scope").when(twice(add), "scope_added_twice").when(empty(remove), "empty_scope")
        .when(twice(remove), "scope_removed_twice").when(F.arrays_overlap(add, remove), "scope_added_and_removed")
    )
    return table.withColumn("violation", kind)


def mutations(table: DataFrame) -> DataFrame:
    """``table`` with op, base_version and client_version as text."""
    base, own = F.col("base_version"), F.col("client_version")
    needs = F.col("op").isin("insert", "update", "upsert") & (F.trim(F.coalesce(own, F.lit(""))) == "")
    kind = (
        F.when(base.isNotNull() & ~F.coalesce(is_timestamp(base), F.lit(False)), "bad_base_version").when(needs, "no_client_version")
        .when(own.isNotNull() & ~F.coalesce(is_timestamp(own), F.lit(False)), "bad_client_version")
    )
    return table.withColumn("violation", kind)


def pull_pages(table: DataFrame) -> DataFrame:
    """``table`` with has_more and checksums: the last page must bring checksums."""
    return table.withColumn("violation", F.when(~F.col("has_more") & F.col("checksums").isNull(), "no_final_checksums"))


def rebuild_pages(table: DataFrame) -> DataFrame:
    """``table`` with has_more, final_cursor and checksum: both belong to the last page and to no other."""
    more, cursor, checksum = F.col("has_more"), F.col("final_cursor"), F.col("checksum")
    kind = (
        F.when(more & cursor.isNotNull(), "early_final_cursor").when(more & checksum.isNotNull(), "early_checksum")
        .when(~more & cursor.isNull(), "no_final_cursor").when(~more & checksum.isNull(), "no_final_checksum")
    )
    return table.withColumn("violation", kind)


def manifest(columns: DataFrame, uses: DataFrame) -> DataFrame:
    """(table_name, column_name, violation) of a manifest's ``columns`` (table_name, column_name, portable_type) and of the names that
    keys, times and indexes use (table_name, column_name, purpose)."""
    per = columns.groupBy("table_name", "column_name").agg(F.count("*").alias("n"), F.min(F.col("portable_type").isin(*EXACT)).alias("known"))
    kind = (
        F.when(F.coalesce("table_name", F.lit("")) == "", "empty_table_name").when(F.coalesce("column_name", F.lit("")) == "", "empty_column_name")
        .when(~F.col("known"), "unsupported_type").when(F.col("n") > 1, "column_twice")
    )
    own = per.select("table_name", "column_name", kind.alias("violation")).filter("violation is not null")
    absent = uses.join(per, ["table_name", "column_name"], "left_anti")
    return own.union(absent.select("table_name", "column_name", F.concat(F.lit("unknown_"), "purpose").alias("violation")))
