"""Which scopes each record belongs to, and how that changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["table_name", "record_id", "scope_id"]


def resolved(rows: DataFrame, unique: bool = False) -> DataFrame:
    """(record_id, scope_id): distinct, without empty or null scopes. ``unique``: a record has one row, so nothing is to be compared."""
    found = rows.select(F.col("record_id").cast("string"), "scope_id").filter("scope_id <> ''")
    return found if unique else found.distinct()


def constant(table: DataFrame, pk: Column, scope: str) -> DataFrame:
    return resolved(table.select(pk.alias("record_id"), F.lit(scope).alias("scope_id")), unique=True)


def owned(table: DataFrame, pk: Column, scope: Column, unique: bool = True) -> DataFrame:
    """``unique``: whether ``pk`` tells the table's rows apart."""
    return resolved(table.select(pk.alias("record_id"), scope.alias("scope_id")), unique)


def chained(table: DataFrame, pk: Column, steps: list[tuple[DataFrame, str, str]], scope: Column, unique: bool = True) -> DataFrame:
    """Scopes through foreign keys: each step joins (parent, child's column, parent's column); set-wise, one equi-join a level.

    ``unique``: whether ``pk`` and the parents' columns tell their tables' rows apart.
    """
    joined = reduce(lambda t, s: t.join(s[0], t[s[1]] == s[0][s[2]]), steps, table)
    return resolved(joined.select(pk.alias("record_id"), scope.alias("scope_id")), unique)


def fellows(members: DataFrame, group: str, record: str, user: str) -> DataFrame:
    """Scopes of membership rows themselves: each row belongs to every member of its group (a self-join on the group)."""
    others = members.select(F.col(group).alias("_group"), F.col(user).alias("_user")).distinct()
    met = members.join(others, members[group] == others["_group"])
    return resolved(met.select(F.col(record).alias("record_id"), F.concat(F.lit("user:"), F.col("_user").cast("string")).alias("scope_id")))


def either(*paths: DataFrame) -> DataFrame:
    """Several ways to belong: the union of their scopes."""
    return resolved(reduce(DataFrame.union, paths))


def scope_list(found: Column) -> Column:
    """A record's scopes as an array: each once, in order of first appearance, without empty ones."""
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull() & (x != "")))


def list_difference(existing: Column, desired: Column) -> tuple[Column, Column, Column]:
    """(added, kept, removed) of two scope arrays: the first two in desired order, the third in existing order."""
    return F.array_except(desired, existing), F.array_intersect(desired, existing), F.array_except(existing, desired)


def edges(table_name: str, members: DataFrame, checksums: DataFrame) -> DataFrame:
    """Membership rows with the checksum of the present row; null where the row is gone."""
    return members.join(checksums, "record_id", "left").select(F.lit(table_name).alias("table_name"), "record_id", "scope_id", "checksum")


def difference(existing: DataFrame, desired: DataFrame) -> DataFrame:
    """(table_name, record_id, scope_id, change): added, kept or removed."""
    old, new = existing.select(*KEY, F.lit(True).alias("was")), desired.select(*KEY, F.lit(True).alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("kept")
    return old.join(new, KEY, "full").select(*KEY, change.alias("change"))


def diff_entries(events: DataFrame, existing: DataFrame, desired: DataFrame) -> DataFrame:
    """Change-log entries of ``events`` (table_name, record_id, operation, and position where a record has several).

    A delete leaves every existing scope (every desired one if none exist). Otherwise a kept scope gets the event's operation (an
    insert there is an update), an added scope an insert, a removed scope a delete. An event sees what the record's event before it left:
    no scopes after a delete, the desired ones after anything else.
    """
    record = ["table_name", "record_id"]
    several = "position" in events.columns
    pairs = difference(existing, desired)
    has = existing.select(*record).distinct().withColumn("had", F.lit(True))
    earlier = F.lag("operation").over(Window.partitionBy(*record).orderBy("position")) if several else F.lit(None).cast("int")
    met = events.withColumn("earlier", earlier).join(pairs, record).join(has, record, "left")
    gone, first, wanted = F.col("operation") == 3, F.col("earlier").isNull(), F.col("change") != "removed"
    written = F.when(F.col("operation") == 1, 2).otherwise(F.col("operation"))
    out = (
        F.when(~first, F.when(wanted, F.when(gone, 3).when(F.col("earlier") == 3, 1).otherwise(written)))
        .when(gone, F.when(F.col("had").isNull() | (F.col("change") != "added"), 3))
        .when(F.col("change") == "added", 1).when(F.col("change") == "removed", 3).otherwise(written)
    )
    return met.select(*KEY, out.cast("int").alias("operation"), *["position"] * several).filter("operation is not null")


def apply_events(current: DataFrame, events: DataFrame, desired: DataFrame) -> DataFrame:
    """Edges after ``events``: touched records lose their edges and get the desired ones (with checksum); none where the record's last
    event (by position, where it has several) is a delete."""
    record = ["table_name", "record_id"]
    last = F.max_by("operation", "position") if "position" in events.columns else F.max("operation")
    ended = events.groupBy(*record).agg(last.alias("operation"))
    kept = current.join(ended.select(*record), record, "left_anti")
    alive = ended.filter("operation <> 3").select(*record)
    return kept.unionByName(desired.join(alive, record, "left_semi").select(*current.columns))


def checksums(members: DataFrame) -> DataFrame:
    """XOR of the non-null checksums of every scope, 0 without any."""
    return members.groupBy("scope_id").agg(F.coalesce(F.bit_xor("checksum"), F.lit(0)).alias("checksum"), F.count("*").alias("members"))
