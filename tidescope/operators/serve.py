"""What clients are served: change records, snapshots, subscriptions and seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def change_records(entries: DataFrame, rows: DataFrame, keys: dict[str, str] | None = None) -> DataFrame:
    """Entries with their present row (table_name, record_id, row_json, row_version, checksum).

    An upsert whose row is gone is left out. A delete stays, and brings the row where it is still there: a client keeps such a
    tombstone. ``keys``: the key column of each table, ``id`` for others; the key goes out as a JSON object.
    """
    op = F.when(F.col("operation") == 3, "delete").otherwise("upsert")
    met = entries.join(rows, ["table_name", "record_id"], "left").filter("operation = 3 or row_json is not null")
    version = F.coalesce("row_version", F.col("seq").cast("string"))
    name = F.lit("id")
    if keys:
        name = F.coalesce(F.create_map(*[F.lit(x) for pair in keys.items() for x in pair])[F.col("table_name")], name)
    pk = F.to_json(F.create_map(name, F.col("record_id")))
    own = [c for c in ("user_id", "client_id") if c in entries.columns]
    return met.select(*own, "scope_id", "table_name", "record_id", pk.alias("pk"), op.alias("op"), "seq", "row_json", version.alias("version"), "checksum")


def parse_page_cursor(cursor: str | None) -> tuple[str, str] | None:
    """``table|record``, split at the first pipe; without a pipe there is no cursor."""
    return tuple(cursor.split("|", 1)) if cursor and "|" in cursor else None


def scope_page(edges: DataFrame, scope_id: str, cursor: str | None, limit: int) -> DataFrame:
    """The next ``limit`` members of a scope after ``cursor`` in (table_name, record_id) order."""
    some = edges.filter(F.col("scope_id") == scope_id)
    if after := parse_page_cursor(cursor):
        table, record = after
        some = some.filter(F.col("table_name") >= table)  # reaches the scan; the rest decides
        some = some.filter((F.col("table_name") > table) | (F.col("record_id") > record))
    return some.orderBy("table_name", "record_id").limit(limit).select("table_name", "record_id", "checksum")


def snapshot(edges: DataFrame, rows: DataFrame, scope_id: Column | None = None) -> DataFrame:
    """Live rows of every scope (or of one): edges joined with rows that are not soft-deleted."""
    some = edges if scope_id is None else edges.filter(F.col("scope_id") == scope_id)
    return some.join(rows.filter("not deleted"), ["table_name", "record_id"]).select("scope_id", "table_name", "record_id", "row_json")


def ensured(clients: DataFrame, shared: DataFrame) -> DataFrame:
    """Clients with the scopes that the server assigns: their own and the shared ones in order; the version counts changes."""
    names = shared.agg(F.array_sort(F.collect_set("scope_id")).alias("shared"))  # the registry of shared scopes
    wanted = F.concat(F.array(F.concat(F.lit("user:"), F.col("user_id"))), F.col("shared"))
    met = clients.crossJoin(F.broadcast(names)).withColumn("wanted", wanted)
    changed = ~F.col("wanted").eqNullSafe(F.col("scopes"))
    return met.select("user_id", "client_id", F.col("wanted").alias("scopes"), (F.col("scope_set_version") + changed.cast("long")).alias("scope_set_version"))


def scope_delta(known: Column, assigned: Column) -> tuple[Column, Column]:
    """(add in server order, remove in key order)."""
    return F.array_except(assigned, known), F.array_sort(F.array_except(known, assigned))


def manifest(tables: dict[str, DataFrame]) -> list[dict]:
    """Columns of every table by name, with portable types."""
    from tidescope.functions.types import of_spark

    return [{"table": t, "position": i, "column": f.name, "type": of_spark(f.dataType), "nullable": f.nullable} for t in sorted(tables) for i, f in enumerate(tables[t].schema.fields)]
