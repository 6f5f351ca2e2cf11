"""What a server does for its clients, many at once: connecting, pulling, rebuilding, pushing, shared scopes, and reports on its state.

Tables: clients (user_id, client_id, scopes, scope_set_version, is_active, last_sync), checkpoints (user_id, client_id, scope_id,
checkpoint), shared scopes (scope_id, portable), the change log (seq, scope_id, table_name, record_id, operation), edges (table_name, record_id,
scope_id, checksum) and present rows (table_name, record_id, row_json, row_version, checksum, deleted).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidescope.functions.rules import clamp
from tidescope.operators import changelog, scopes, serve, writes

CLIENT = ["user_id", "client_id"]
#: Fixed value: the protocol that clients must speak.
PROTOCOL = 2


def contract_info() -> dict:
    """What a client may rely on."""
    return {"protocol_version": PROTOCOL, "default_limit": clamp(0), "max_limit": clamp(1 << 30)}


def ensured(clients: DataFrame, checkpoints: DataFrame, shared: DataFrame, present: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clients, checkpoints) once the clients of ``present`` (user_id, client_id) are there: they are active and have their own scope and
    all shared ones; the version counts changes of the list; a scope that is new to a client has checkpoint 0."""
    names = shared.agg(F.array_sort(F.collect_set("scope_id")).alias("shared"))  # one row: the registry of shared scopes
    wanted = F.concat(F.array(F.concat(F.lit("user:"), F.col("user_id"))), F.col("shared"))
    now = present.select(*CLIENT).distinct().crossJoin(F.broadcast(names)).select(*CLIENT, wanted.alias("wanted"))
    met = clients.join(now, CLIENT, "full")
    here = F.col("wanted").isNotNull()
    changed = here & F.col("scope_set_version").isNotNull() & ~F.col("wanted").eqNullSafe(F.col("scopes"))
    after = met.select(
        *CLIENT, F.coalesce("wanted", "scopes").alias("scopes"), (F.coalesce("scope_set_version", F.lit(1)) + changed.cast("long")).cast("long").alias("scope_set_version"),
        (here | F.coalesce("is_active", F.lit(False))).alias("is_active"), "last_sync",
    )
    fresh = now.select(*CLIENT, F.explode("wanted").alias("scope_id")).join(checkpoints, [*CLIENT, "scope_id"], "left_anti")
    return after, checkpoints.select(*CLIENT, "scope_id", "checkpoint").union(fresh.select(*CLIENT, "scope_id", F.lit(0).cast("long")))


def schema_problem(version: Column, hash_: Column, server: tuple[int, str] | None) -> Column:
    """``schema_mismatch`` where a client's schema is not the server's; a client without one, or a server without one, passes."""
    if server is None:
        return F.lit(None).cast("string")
    same = (version == server[0]) & (hash_ == server[1])
    return F.when(~(same | ((version == 0) & (hash_ == ""))), "schema_mismatch")


def connect(requests: DataFrame, clients: DataFrame, checkpoints: DataFrame, shared: DataFrame, schema: tuple[int, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(responses, clients, checkpoints) for ``requests`` (user_id, client_id, protocol_version, schema_version, schema_hash, known_scopes).

    A response has error (``upgrade_required`` for another protocol; such a client is not touched), scope_set_version, schema_action and the
    scopes to add, in the server's order, and to remove, in key order.
    """
    good = F.coalesce(F.col("protocol_version") == PROTOCOL, F.lit(False))
    after, points = ensured(clients, checkpoints, shared, requests.filter(good))
    add, remove = serve.scope_delta(F.col("known_scopes"), F.col("scopes"))
    same = (F.col("schema_version") == schema[0]) & (F.col("schema_hash") == schema[1])
    met = requests.join(after.select(*CLIENT, "scopes", "scope_set_version"), CLIENT, "left")
    responses = met.select(
        *CLIENT, F.when(~good, "upgrade_required").alias("error"), F.when(good, F.col("scope_set_version")).alias("scope_set_version"),
        F.when(good, F.when(same, "none").otherwise("replace")).alias("schema_action"), F.when(good, add).alias("add"), F.when(good, remove).alias("remove"),
    )
    return responses, after, points


@dataclass
class Pulled:
    """``changes``: change records by client; ``states``: of each client's scopes the next cursor, whether it is to be rebuilt, and on the
    last page the checksum; ``answers``: by client has_more, scope_set_version, add and remove."""

    changes: DataFrame
    states: DataFrame
    answers: DataFrame


def pull(requests: DataFrame, clients: DataFrame, log: DataFrame, edges: DataFrame, rows: DataFrame, limit: int = 0, tables: list[str] | None = None, keys: dict[str, str] | None = None) -> Pulled:
    """The next page of every client of ``requests`` (user_id, client_id, scope_id, cursor: none, ok or stale, checkpoint: what an ok cursor holds).

    Served are the scopes that are asked for and assigned. One whose cursor is stale, or lies before the log's beginning, is to be rebuilt and gets no
    changes. The page is the first ``limit`` entries past the cursors; of a record's entries the last one counts; rows come with
    their change. A scope's cursor moves to its last entry on the page.
    """
    limit = clamp(limit)
    known = clients.select(*CLIENT, F.posexplode("scopes").alias("place", "scope_id"))
    mine = requests.join(known, [*CLIENT, "scope_id"])
    low = log.agg(F.min("seq").alias("low"))  # one row
    late = F.coalesce((F.col("checkpoint") > 0) & (F.col("checkpoint") < F.col("low")), F.lit(False)) | ((F.col("cursor") == "none") & F.col("low").isNotNull())
    mine = mine.crossJoin(F.broadcast(low)).withColumn("rebuild", (F.col("cursor") == "stale") | late).drop("low")
    current = mine.filter("not rebuild").select(*CLIENT, "scope_id", F.coalesce("checkpoint", F.lit(0)).alias("checkpoint"))
    some = log.filter("scope_id <> '' and table_name <> '' and record_id <> '' and operation in (1, 2, 3)")
    if tables:
        some = some.filter(F.col("table_name").isin(tables))
    place = F.row_number().over(Window.partitionBy(*CLIENT).orderBy("seq", "scope_id"))
    probe = some.join(current, "scope_id").filter("seq > checkpoint").withColumn("place", place).filter(F.col("place") <= limit + 1)
    more = probe.groupBy(*CLIENT).agg((F.max("place") > limit).alias("has_more"))
    page = probe.filter(F.col("place") <= limit)
    last = F.max_by(F.struct("scope_id", "operation", "seq"), "seq").alias("last")
    kept = page.groupBy(*CLIENT, "table_name", "record_id").agg(F.min("seq").alias("position"), last)
    changes = serve.change_records(kept.select(*CLIENT, "table_name", "record_id", "last.scope_id", "last.operation", "last.seq"), rows, keys)
    ended = page.groupBy(*CLIENT, "scope_id").agg(F.max("seq").alias("moved"))
    sums = edges.groupBy("scope_id").agg(F.coalesce(F.bit_xor("checksum"), F.lit(0)).alias("sum"))
    states = mine.join(more, CLIENT, "left").join(ended, [*CLIENT, "scope_id"], "left").join(sums, "scope_id", "left")
    final = ~F.col("rebuild") & ~F.coalesce("has_more", F.lit(False))
    states = states.select(*CLIENT, "scope_id", "rebuild", F.when(~F.col("rebuild"), F.coalesce("moved", "checkpoint")).alias("next"), F.when(final, F.coalesce("sum", F.lit(0))).alias("checksum"))
    asked = requests.groupBy(*CLIENT).agg(F.collect_set("scope_id").alias("known"))
    add, remove = serve.scope_delta(F.col("known"), F.col("scopes"))
    answers = asked.join(clients.select(*CLIENT, "scopes", "scope_set_version"), CLIENT).join(more, CLIENT, "left")
    return Pulled(changes, states, answers.select(*CLIENT, F.coalesce("has_more", F.lit(False)).alias("has_more"), "scope_set_version", add.alias("add"), remove.alias("remove")))


def rebuild(user: str, client: str, scope: str, clients: DataFrame, log: DataFrame, edges: DataFrame, rows: DataFrame, cursor: str | None = None, limit: int = 0) -> dict:
    """A page of a scope's live rows in (table_name, record_id) order, as plain values: records, cursor, checkpoint, has_more, and on the last page the checksum.

    At most ``limit`` rows come to the driver. The checkpoint is the log's last number when the page is read.
    """
    mine = (F.col("user_id") == user) & (F.col("client_id") == client) & F.array_contains("scopes", scope)
    if clients.filter(mine).isEmpty():
        raise PermissionError(f"client {client} does not subscribe to {scope}")
    limit = clamp(limit)
    found = serve.scope_page(edges, scope, cursor, limit + 1).collect()
    more, found = len(found) > limit, found[:limit]
    page = edges.sparkSession.createDataFrame([tuple(r) for r in found], "table_name string, record_id string, checksum long")
    live = rows.filter("not deleted").join(F.broadcast(page.select("table_name", "record_id")), ["table_name", "record_id"], "left_semi")  # at most limit keys
    records = sorted((r.asDict() for r in live.select("table_name", "record_id", "row_json", "row_version", "checksum").collect()), key=lambda r: (r["table_name"], r["record_id"]))
    at = log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    out = {"records": records, "has_more": more, "cursor": None, "checkpoint": None, "checksum": None}
    if more:
        return out | {"cursor": f"{found[-1]['table_name']}|{found[-1]['record_id']}"}
    total = edges.filter(F.col("scope_id") == scope).agg(F.coalesce(F.bit_xor("checksum"), F.lit(0))).first()[0]
    return out | {"checkpoint": at, "checksum": total}


def rebuild_all(wanted: DataFrame, clients: DataFrame, log: DataFrame, edges: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, done): the live rows of every scope in ``wanted`` (user_id, client_id, scope_id) that its client subscribes to, in one pass, and for
    each the checkpoint and the checksum that end its rebuild."""
    mine = wanted.join(clients.select(*CLIENT, F.explode("scopes").alias("scope_id")), [*CLIENT, "scope_id"], "left_semi")
    live = rows.filter("not deleted").select("table_name", "record_id", "row_json", "row_version", F.col("checksum").alias("row_checksum"))
    records = mine.join(edges, "scope_id").join(live, ["table_name", "record_id"]).select(*CLIENT, "scope_id", *live.columns)
    sums = edges.groupBy("scope_id").agg(F.coalesce(F.bit_xor("checksum"), F.lit(0)).alias("sum"))
    high = log.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("long").alias("checkpoint"))  # one row
    done = mine.join(sums, "scope_id", "left").crossJoin(F.broadcast(high))
    return records, done.select(*CLIENT, "scope_id", "checkpoint", F.coalesce("sum", F.lit(0)).alias("checksum"))


def complete_rebuild(clients: DataFrame, checkpoints: DataFrame, done: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(clients, checkpoints) after rebuilds ``done`` (user_id, client_id, scope_id, checkpoint): the scope's checkpoint is set, the client's lower ones
    are raised to it, and its last sync is ``now``."""
    high = done.groupBy(*CLIENT).agg(F.max("checkpoint").alias("high"))
    every = checkpoints.select(*CLIENT, "scope_id", "checkpoint").join(done.select(*CLIENT, "scope_id"), [*CLIENT, "scope_id"], "left_anti").union(done.select(*CLIENT, "scope_id", "checkpoint"))
    points = every.join(high, CLIENT, "left").select(*CLIENT, "scope_id", F.greatest("checkpoint", F.coalesce("high", F.lit(0))).cast("long").alias("checkpoint"))
    touched = clients.join(high, CLIENT, "left").withColumn("last_sync", F.when(F.col("high").isNotNull(), F.lit(now)).otherwise(F.col("last_sync")))
    return touched.select(*clients.columns), points


@dataclass
class Pushed:
    """``results``: of each mutation status, code, message and version; ``table``: the table afterwards; ``edges`` and ``entries``: its edges
    afterwards and what the change log gets."""

    results: DataFrame
    table: DataFrame
    edges: DataFrame
    entries: DataFrame


def push(
    mutations: DataFrame, table: DataFrame, name: str, pk: str, columns: list[str], edges: DataFrame, desired: Callable[[DataFrame], DataFrame], last: int,
    updated_at: str | None = "updated_at", deleted_at: str | None = "deleted_at", policy: str = "enabled", required: list[str] | None = None,
    now: Column | None = None, hook: Callable[[DataFrame], DataFrame] | None = None,
) -> Pushed:
    """Apply ``mutations`` (mutation_id, record_id, op, client_time, base, payload: JSON) to one table; one for each record.

    ``columns``: those a client may write. ``desired``: the edges (with checksums) of a table's rows as they are afterwards. ``last``: the log's last number.
    ``hook``: see :func:`writes.hooked`. ``now``: a timestamp, the present time if none is given.
    """
    now = F.current_timestamp() if now is None else now
    made = mutations.withColumn("refused", F.lit(None).cast("string"))
    if hook is not None:
        made = writes.hooked(mutations, hook, columns)
    keys = F.map_filter(F.from_json("payload", "map<string,string>"), lambda k, _: k.isin(columns))
    made = made.withColumn("table_name", F.lit(name)).withColumn("columns", F.coalesce(F.map_keys(keys), F.array().cast("array<string>")))
    made = made.withColumn("filled", F.coalesce(F.map_keys(F.map_filter(keys, lambda _, v: v.isNotNull())), F.array().cast("array<string>")))
    when = lambda c: F.unix_millis(F.col(c).cast("timestamp")) if c else F.lit(None).cast("long")
    gone = F.col(deleted_at).isNotNull() if deleted_at else F.lit(False)
    rows = table.select(F.lit(name).alias("table_name"), F.col(pk).cast("string").alias("record_id"), when(updated_at).alias("updated"), gone.alias("deleted"))
    need = F.array(*[F.lit(c) for c in required or ()]).cast("array<string>")
    registry = table.sparkSession.range(1).select(F.lit(name).alias("table_name"), F.lit(policy).alias("push_policy"), F.lit(bool(updated_at)).alias("has_updated"), F.lit(bool(deleted_at)).alias("has_deleted"), need.alias("required"))
    found = writes.resolve(made, rows, registry, F.unix_millis(now))
    no = F.col("refused").isNotNull()
    found = found.select(
        "mutation_id", "table_name", "record_id", "op", "client_time", "payload", F.when(no, "rejected_terminal").otherwise(F.col("status")).alias("status"),
        F.when(no, "policy_rejected").otherwise(F.col("code")).alias("code"), F.coalesce("refused", "message").alias("message"), F.when(~no, F.col("action")).alias("action"),
    )
    after = writes.written(table, found, pk, columns, updated_at, deleted_at, now)
    stamp = lambda c: F.unix_millis(F.col(c).cast("timestamp")) if c else F.lit(None).cast("long")
    held = after.select(F.col(pk).cast("string").alias("record_id"), stamp(updated_at).alias("u"), stamp(deleted_at).alias("d"))
    met = found.join(held, "record_id", "left")
    version = F.when(F.col("action") == "delete", F.coalesce("d", "u")).otherwise(F.coalesce("u", "d"))
    version = F.when(F.col("status").isin("applied", "conflict"), F.coalesce(version, F.unix_millis(now)))
    results = met.select("mutation_id", "table_name", "record_id", "op", "status", "code", "message", version.alias("version"))
    done = found.filter("action in ('insert', 'update', 'resurrect', 'delete', 'remove')")
    events = done.select("table_name", "record_id", F.when(F.col("action") == "insert", 1).when(F.col("action").isin("delete", "remove"), 3).otherwise(2).alias("operation"))
    mine = edges.filter(F.col("table_name") == name)
    touched = mine.join(events.select("table_name", "record_id"), ["table_name", "record_id"], "left_semi")
    wanted = desired(after).join(events.filter("operation <> 3").select("table_name", "record_id"), ["table_name", "record_id"], "left_semi")
    entries = changelog.append(scopes.diff_entries(events, touched, wanted), ["record_id", "scope_id"], last)
    return Pushed(results, after, scopes.apply_events(edges, events, wanted), entries)


def share(clients: DataFrame, checkpoints: DataFrame, shared: DataFrame, scope_id: str, portable: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clients, checkpoints, shared) once a scope is shared: active clients without it get it at their list's end, and checkpoint 0."""
    lacks = F.col("is_active") & ~F.array_contains("scopes", scope_id)
    after = clients.withColumn("scope_set_version", F.col("scope_set_version") + lacks.cast("long")).withColumn("scopes", F.when(lacks, F.array_append("scopes", F.lit(scope_id))).otherwise(F.col("scopes")))
    fresh = clients.filter("is_active").select(*CLIENT, F.lit(scope_id).alias("scope_id")).join(checkpoints, [*CLIENT, "scope_id"], "left_anti")
    points = checkpoints.select(*CLIENT, "scope_id", "checkpoint").union(fresh.select(*CLIENT, "scope_id", F.lit(0).cast("long")))
    listed = shared.filter(F.col("scope_id") != scope_id).select("scope_id", "portable")
    return after.select(*clients.columns), points, listed.union(shared.sparkSession.range(1).select(F.lit(scope_id), F.lit(portable)))


def unshare(clients: DataFrame, checkpoints: DataFrame, shared: DataFrame, scope_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clients, checkpoints, shared) once a scope is shared no more: active clients lose it, and every client its checkpoint."""
    has = F.col("is_active") & F.array_contains("scopes", scope_id)
    after = clients.withColumn("scope_set_version", F.col("scope_set_version") + has.cast("long")).withColumn("scopes", F.when(has, F.array_remove("scopes", scope_id)).otherwise(F.col("scopes")))
    other = F.col("scope_id") != scope_id
    return after.select(*clients.columns), checkpoints.filter(other), shared.filter(other)


def debug(clients: DataFrame, checkpoints: DataFrame, edges: DataFrame) -> DataFrame:
    """Of every client and each of its scopes: checkpoint, members, and checksum (null for a scope without members)."""
    mine = clients.select(*CLIENT, "is_active", "scope_set_version", F.explode("scopes").alias("scope_id"))
    sums = edges.groupBy("scope_id").agg(F.count("*").alias("members"), F.bit_xor("checksum").alias("checksum"))
    met = mine.join(checkpoints, [*CLIENT, "scope_id"], "left").join(sums, "scope_id", "left")
    return met.select(*CLIENT, "is_active", "scope_set_version", "scope_id", F.coalesce("checkpoint", F.lit(0)).alias("checkpoint"), F.coalesce("members", F.lit(0)).alias("members"), "checksum")


def client_debug(provenance: DataFrame, held: DataFrame, pending: DataFrame) -> DataFrame:
    """A client's own report: of each scope it holds members, checksum and cursor, with the number of queued changes."""
    sums = provenance.groupBy("scope_id").agg(F.count("*").alias("members"), F.coalesce(F.bit_xor("checksum"), F.lit(0)).alias("checksum"))
    waiting = pending.agg(F.count("*").alias("pending"))  # one row
    met = held.select("scope_id", "cursor").join(sums, "scope_id", "left").crossJoin(F.broadcast(waiting))
    return met.select("scope_id", "cursor", F.coalesce("members", F.lit(0)).alias("members"), F.coalesce("checksum", F.lit(0)).alias("checksum"), "pending")
