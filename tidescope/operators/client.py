"""A client's copy: rows, which scope holds each (provenance), scopes with their cursors, and what is still to be pushed.

Rows are (table_name, record_id, row_json, version), provenance is (scope_id, table_name, record_id, checksum, generation), scopes are
(scope_id, cursor, checksum, generation). Many clients at once: put a client's id in front of table_name and scope_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = ["table_name", "record_id"]


def apply_changes(rows: DataFrame, provenance: DataFrame, scopes: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, provenance) after a page of ``changes`` (scope_id, table_name, record_id, seq, op, row_json, version, checksum).

    Of several changes to a record the last one counts for its row, and of several in a scope the last one for the scope. A row that is
    not newer than the local one leaves that alone; a delete without a row takes the row away once no scope holds it.
    """
    key = ["scope_id", *RECORD]
    last = changes.groupBy(*key).agg(F.max_by(F.struct("op", "checksum"), "seq").alias("c")).select(*key, "c.op", "c.checksum")
    held = last.filter("op <> 'delete'").join(scopes.select("scope_id", "generation"), "scope_id").select(*key, "checksum", "generation")
    after = provenance.join(last.select(*key), key, "left_anti").select(*held.columns).union(held)
    brought = changes.filter("row_json is not null").groupBy(*RECORD).agg(F.max_by(F.struct("row_json", "version"), "seq").alias("c"))
    local = rows.select(*RECORD, F.col("version").alias("local"))
    newer = brought.join(local, RECORD, "left").filter("local is null or local < c.version").select(*RECORD, "c.row_json", "c.version")
    kept = rows.join(newer.select(*RECORD), RECORD, "left_anti").select(*newer.columns).union(newer)
    bare = changes.filter("op = 'delete' and row_json is null").select(*RECORD).distinct()
    gone = bare.join(after.select(*RECORD), RECORD, "left_anti")
    return kept.join(gone, RECORD, "left_anti").select(*newer.columns), after


def known_tables(changes: DataFrame, tables: DataFrame) -> DataFrame:
    """The changes to tables (table_name, has_deleted) that this client has; others are skipped. A tombstone for a table that can't keep one is an error."""
    met = changes.join(tables.select("table_name", "has_deleted"), "table_name")
    bad = (F.col("op") == "delete") & F.col("row_json").isNotNull() & ~F.col("has_deleted")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("tombstone without a deletion time: "), "table_name"))).otherwise(F.col("op"))
    return met.withColumn("op", checked.cast("string")).select(*changes.columns)


def upserted(changes: DataFrame, columns: list[str], pk: str) -> DataFrame:
    """Rows of one table from ``changes`` (record_id, row_json): all its columns as text, absent ones null, an absent key the record's id."""
    values = F.from_json("row_json", "map<string,string>")
    return changes.withColumn("_v", values).select(*[(F.coalesce(F.col("_v")[c], F.col("record_id")) if c == pk else F.col("_v")[c]).alias(c) for c in columns])


def apply_scope_delta(scopes: DataFrame, rows: DataFrame, provenance: DataFrame, add: list[str], remove: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scopes, rows, provenance) after the server's delta: scopes that go take along the rows that they alone hold, then new ones come without a cursor."""
    spark = scopes.sparkSession
    gone = F.col("scope_id").isin(remove)
    after = provenance.filter(~gone)
    lone = provenance.filter(gone).select(*RECORD).distinct().join(after.select(*RECORD), RECORD, "left_anti")
    fresh = spark.createDataFrame([(s,) for s in dict.fromkeys(add)], "scope_id string").join(scopes.select("scope_id"), "scope_id", "left_anti")
    fresh = fresh.select("scope_id", F.lit(None).cast("string").alias("cursor"), F.lit(None).cast(scopes.schema["checksum"].dataType).alias("checksum"), F.lit(0).cast(scopes.schema["generation"].dataType).alias("generation"))
    held = scopes.filter(~gone).select("scope_id", "cursor", "checksum", "generation").union(fresh)
    return held, rows.join(lone, RECORD, "left_anti").select(*rows.columns), after


def invalidate(scopes: DataFrame, provenance: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scopes, provenance) when nothing held is to be trusted: no cursors, no checksums, generation 0, nobody holds a row."""
    kinds = scopes.schema
    none = scopes.select("scope_id", F.lit(None).cast(kinds["cursor"].dataType).alias("cursor"), F.lit(None).cast(kinds["checksum"].dataType).alias("checksum"), F.lit(0).cast(kinds["generation"].dataType).alias("generation"))
    return none, provenance.limit(0)


def local_only(edits: DataFrame) -> DataFrame:
    """The edits that were made here (``origin`` is local): what a server's page writes is never queued."""
    return edits.filter("origin = 'local'").drop("origin")


def finish_rebuild(rows: DataFrame, provenance: DataFrame, scopes: DataFrame, scope_id: str, cursor: str, checksum: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, provenance, scopes) after a rebuild's last page: what the scope held before this generation goes, with rows that no scope holds any more; the
    XOR of what is left must be the server's, or the rebuild is an error."""
    now = scopes.filter(F.col("scope_id") == scope_id).first()["generation"]
    mine = F.col("scope_id") == scope_id
    stale = mine & (F.col("generation") != now)
    after = provenance.filter(~stale)
    lone = provenance.filter(stale).select(*RECORD).distinct().join(after.select(*RECORD), RECORD, "left_anti")
    own = after.filter(mine).agg(F.coalesce(F.bit_xor("checksum"), F.lit(0)).alias("own")).first()["own"]
    if own != checksum:
        raise ValueError(f"scope {scope_id}: rebuilt to checksum {own}, the server has {checksum}")
    held = scopes.select("scope_id", F.when(mine, F.lit(cursor)).otherwise(F.col("cursor")).alias("cursor"), F.when(mine, F.lit(checksum)).otherwise(F.col("checksum")).cast(scopes.schema["checksum"].dataType).alias("checksum"), "generation")
    return rows.join(lone, RECORD, "left_anti").select(*rows.columns), after, held


def remove_scope(rows: DataFrame, provenance: DataFrame, scope_id: str) -> tuple[DataFrame, DataFrame]:
    """(rows, provenance) without a scope; rows go that it alone held."""
    mine = F.col("scope_id") == scope_id
    after = provenance.filter(~mine)
    gone = provenance.filter(mine).select(*RECORD).distinct().join(after.select(*RECORD), RECORD, "left_anti")
    return rows.join(gone, RECORD, "left_anti").select(*rows.columns), after


def begin_rebuild(scopes: DataFrame, scope_ids: list[str]) -> DataFrame:
    """The given scopes get the next generation and lose cursor and checksum."""
    mine = F.col("scope_id").isin(scope_ids)
    return scopes.select(
        "scope_id", F.when(~mine, F.col("cursor")).alias("cursor"), F.when(~mine, F.col("checksum")).alias("checksum"),
        (F.col("generation") + F.when(mine, 1).otherwise(0)).alias("generation"),
    )


def end_page(scopes: DataFrame, cursors: DataFrame, server: DataFrame, provenance: DataFrame) -> DataFrame:
    """Scopes after a page: ``cursors`` (scope_id, cursor) move on; on the last page ``server`` (scope_id, checksum) is compared with the
    XOR of what the scope holds, and a scope that differs loses its cursor, which has it rebuilt."""
    own = provenance.groupBy("scope_id").agg(F.bit_xor("checksum").alias("own"))
    met = (
        scopes.join(cursors.select("scope_id", F.col("cursor").alias("next")), "scope_id", "left")
        .join(server.select("scope_id", F.col("checksum").alias("theirs")), "scope_id", "left").join(own, "scope_id", "left")
    )
    wrong = F.col("theirs").isNotNull() & (F.col("theirs") != F.coalesce("own", F.lit(0)))
    return met.select(
        "scope_id", F.when(~wrong, F.coalesce("next", "cursor")).alias("cursor"),
        F.when(~wrong, F.coalesce("theirs", "checksum")).alias("checksum"), "generation",
    )


def to_rebuild(scopes: DataFrame, asked: DataFrame) -> DataFrame:
    """Known scopes that the server asks to rebuild or that have no cursor."""
    met = scopes.join(asked.select("scope_id", F.lit(True).alias("asked")).distinct(), "scope_id", "left")
    return met.filter("asked or cursor is null").select("scope_id")


def settle(pending: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pending, rejected) after a push: what was applied or rejected for good leaves the queue, what may be retried stays."""
    final = results.filter("status <> 'rejected_retryable'")
    rejected = final.filter("status <> 'applied'").select("mutation_id", *RECORD, "status", "code")
    return pending.join(final.select(*RECORD).distinct(), RECORD, "left_anti").select(*pending.columns), rejected


def canonical(rows: DataFrame, results: DataFrame) -> DataFrame:
    """``rows`` after a push: the server's row (row_json, version) of every final result that brings one, applied or in conflict, takes the local one's place."""
    brought = results.filter("status <> 'rejected_retryable' and row_json is not null").select(*RECORD, "row_json", "version")
    return rows.join(brought.select(*RECORD), RECORD, "left_anti").select(*brought.columns).union(brought)


def retries(results: DataFrame, attempt: int, most: int = 5) -> bool:
    """Whether another push is due: something may be retried, and fewer than ``most`` attempts were made."""
    return attempt < most and not results.filter("status = 'rejected_retryable'").isEmpty()


def mutations(pending: DataFrame, rows: DataFrame) -> DataFrame:
    """Queued changes as mutations with their present row; a row that is gone is skipped, a delete has no row."""
    met = pending.join(rows.select(*RECORD, "row_json"), RECORD, "left").filter("operation = 'delete' or row_json is not null")
    op = F.when(F.col("operation") == "create", "insert").otherwise(F.col("operation"))
    return met.select(
        F.concat_ws(":", *RECORD, "operation", F.col("client_version").cast("string")).alias("mutation_id"), *RECORD, op.alias("op"),
        "base_version", "client_version", F.when(F.col("operation") != "delete", F.col("row_json")).alias("row_json"),
    )
