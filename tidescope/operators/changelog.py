"""The ordered log of scope changes: appending, reading, deduplication and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidescope.functions.storage import cut


def append(entries: DataFrame, order: list[str], last: int, key: list[str] | None = None) -> DataFrame:
    """Give a batch's ``entries`` the numbers after ``last`` in a deterministic order (for each value of ``key`` apart, if one is given).

    Rows are dealt by ranges of key and order, numbered where they land and stored, so that a lost executor can't deal them anew; only
    a row for each partition (and key there) is counted up in one place.
    """
    key = key or []
    dealt = entries.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    # a number holds the partition in its upper bits and the row's place there in its lower ones
    stored = cut(dealt.withColumn("_number", F.monotonically_increasing_id()))
    part = F.shiftright("_number", 33).alias("_part")
    counts = stored.groupBy(*key, part).agg(F.count("*").alias("_n"), F.min("_number").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*key).orderBy("_part")) - F.col("_n")
    starts = counts.select(*key, "_part", (before - F.col("_first") + last + 1).alias("_shift"))
    return stored.withColumn("_part", part).join(starts, [*key, "_part"]).select((F.col("_number") + F.col("_shift")).alias("seq"), *entries.columns)


def dedup(entries: DataFrame, by_scope: bool = False) -> DataFrame:
    """Per record (and scope, if asked) the last entry, at the position of the first."""
    key = ["table_name", "record_id"] + ["scope_id"] * by_scope
    last = F.max_by(F.struct("scope_id", "operation", "seq"), "seq").alias("last")
    kept = entries.groupBy(*key).agg(F.min("seq").alias("position"), last)
    return kept.select("table_name", "record_id", "last.scope_id", "last.operation", "last.seq", "position")


def page(entries: DataFrame, cursors: DataFrame, limit: int, tables: list[str] | None = None) -> DataFrame:
    """The first ``limit`` entries past each scope's cursor (scope_id, checkpoint), with has_more.

    Scopes filter before the limit applies, so a page is never short while entries remain. ``limit`` is at most 1000 rows.
    """
    some = entries.join(cursors, "scope_id").filter(F.col("seq") > F.coalesce("checkpoint", F.lit(0)))
    if tables:
        some = some.filter(F.col("table_name").isin(tables))
    some = some.filter("scope_id <> '' and record_id <> '' and operation in (1, 2, 3)")
    probe = some.orderBy("seq", "scope_id").limit(limit + 1)
    order = Window.orderBy("seq", "scope_id")  # over limit + 1 rows
    ranked = probe.withColumn("rank", F.row_number().over(order)).withColumn("has_more", F.count("*").over(Window.partitionBy(F.lit(1))) > limit)
    return ranked.filter(F.col("rank") <= limit).select("seq", "scope_id", "table_name", "record_id", "operation", "rank", "has_more")


def stats(entries: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return entries.agg(F.coalesce(F.min("seq"), zero).alias("min_seq"), F.coalesce(F.max("seq"), zero).alias("max_seq"), F.count("*").alias("total"))


def stale_scopes(cursors: DataFrame, entries: DataFrame) -> DataFrame:
    """Scopes to rebuild: no cursor, or one between 0 and the log's first number (exclusive both)."""
    low = entries.agg(F.min("seq").alias("low"))  # one row
    late = F.col("checkpoint").isNull() | ((F.col("checkpoint") > 0) & (F.col("checkpoint") < F.col("low")))
    return cursors.crossJoin(F.broadcast(low)).filter(F.col("low").isNotNull() & late).select("scope_id")


def deactivated(clients: DataFrame, as_of: int, stale_ms: int) -> DataFrame:
    """Active clients whose last sync lies before ``as_of - stale_ms`` (milliseconds)."""
    return clients.filter(F.col("is_active") & (F.col("last_sync") < as_of - stale_ms)).select("user_id", "client_id")


def safe_seq(clients: DataFrame, checkpoints: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: the smallest checkpoint of an active client (0 where they have none); the log's last number without any active client."""
    active = clients.filter("is_active").select("user_id", "client_id")
    low = checkpoints.join(active, ["user_id", "client_id"]).agg(F.coalesce(F.min("checkpoint"), F.lit(0)).cast("long").alias("low"))
    some = active.agg(F.count("*").alias("some"))
    high = entries.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("high"))
    every = low.crossJoin(F.broadcast(some)).crossJoin(F.broadcast(high))  # three aggregates of one row
    return every.select(F.when(F.col("some") > 0, F.col("low")).otherwise(F.col("high")).cast("long").alias("safe_seq"))


def compact(entries: DataFrame, safe: DataFrame) -> DataFrame:
    """Entries past the safe number; all of them where it is 0."""
    return entries.crossJoin(F.broadcast(safe)).filter("safe_seq = 0 or seq > safe_seq").select(*entries.columns)


def compaction(clients: DataFrame, checkpoints: DataFrame, entries: DataFrame, as_of: int, stale_ms: int = 7 * 86_400_000, batch: int = 10_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clients, entries, result) after a run: stale clients become inactive, then entries up to the safe number go.

    ``result`` is one row: deactivated_clients, safe_seq, deleted_entries and batches, the number of deletions of at most ``batch`` entries,
    lowest first, that a store which deletes row by row would take (a table is rewritten in one).
    """
    gone = deactivated(clients, as_of, stale_ms).withColumn("gone", F.lit(True))
    names = ["user_id", "client_id"]
    after = clients.join(gone, names, "left").withColumn("is_active", F.col("is_active") & F.col("gone").isNull()).select(*clients.columns)
    safe = safe_seq(after, checkpoints, entries)
    old = entries.crossJoin(F.broadcast(safe)).agg(F.count(F.when(F.col("seq") <= F.col("safe_seq"), 1)).alias("deleted_entries"))
    result = gone.agg(F.count("*").alias("deactivated_clients")).crossJoin(F.broadcast(safe)).crossJoin(F.broadcast(old))
    runs = F.when(F.col("safe_seq") > 0, F.floor(F.col("deleted_entries") / batch) + 1).otherwise(0).cast("long")
    return after, compact(entries, safe), result.withColumn("batches", runs)
