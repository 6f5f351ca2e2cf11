"""The older way in which a client keeps its rows: members of buckets and one checkpoint, which only moves forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = ["table_name", "record_id"]


def apply_page(rows: DataFrame, members: DataFrame, changes: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, members) after ``changes`` (bucket_id, table_name, record_id, row_json, version, checksum) and ``deletes`` (bucket_id, table_name, record_id).

    A change makes its record a member, a newer row takes the older one's place; a deleted member's row goes once no bucket has it.
    """
    key = ["bucket_id", *RECORD]
    held = changes.select(*key, "checksum")
    after = members.join(held.select(*key), key, "left_anti").select(*held.columns).union(held).join(deletes.select(*key), key, "left_anti").select(*held.columns)
    brought = changes.groupBy(*RECORD).agg(F.max_by(F.struct("row_json", "version"), "version").alias("c"))
    newer = brought.join(rows.select(*RECORD, F.col("version").alias("local")), RECORD, "left").filter("local is null or local < c.version").select(*RECORD, "c.row_json", "c.version")
    kept = rows.join(newer.select(*RECORD), RECORD, "left_anti").select(*newer.columns).union(newer)
    gone = deletes.select(*RECORD).distinct().join(after.select(*RECORD), RECORD, "left_anti")
    return kept.join(gone, RECORD, "left_anti").select(*newer.columns), after


def known_buckets(known: Column, add: Column, remove: Column) -> Column:
    """The list of buckets after an update: those that go are left out, new ones come last."""
    return F.array_union(F.array_except(known, remove), F.array_except(add, remove))


def checksums(members: DataFrame) -> DataFrame:
    """(bucket_id, checksum): XOR of the members' checksums."""
    return members.groupBy("bucket_id").agg(F.coalesce(F.bit_xor("checksum"), F.lit(0)).alias("checksum"))


def moved(checkpoint: Column, given: Column) -> Column:
    """A checkpoint never moves back."""
    return F.greatest(F.coalesce(checkpoint, F.lit(0)), F.coalesce(given, F.lit(0)))
