"""Incoming mutations, and how a client applies what it is served."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidescope.functions.rules import last_write

RECORD = ["table_name", "record_id"]
#: A registry has a row for each synced table; up to so many rows it is broadcast.
FEW_TABLES = 10_000


def small(registry: DataFrame) -> DataFrame:
    return F.broadcast(registry) if registry.limit(FEW_TABLES + 1).count() <= FEW_TABLES else registry


def resolve(mutations: DataFrame, rows: DataFrame, registry: DataFrame, now: Column | None = None, tolerance: int = 500) -> DataFrame:
    """``mutations`` with the outcome of each: op (an upsert resolved), status, code, message, action.

    ``mutations``: mutation_id, table_name, record_id, op, client_time, base (milliseconds), and where payloads count ``columns`` (those that
    may be written) and ``filled`` (those with a value). ``rows``: the present rows (table_name, record_id, updated: milliseconds or null, deleted).
    ``registry``: table_name, push_policy, and where tables differ has_updated, has_deleted, required (columns that an insert must
    fill). One mutation per record; batches with more go through :func:`in_rounds`.

    An insert onto a deleted row goes the way of an update, the last write wins; where a table has no update time or the row has none, there is nothing
    to compare. A delete is never refused for its time: a row that is deleted already is deleted, one that is absent is an error, and a table
    without deletion times always takes it. ``action`` tells what is to be done: insert, update, resurrect, keep, delete, remove; null if rejected.
    """
    held = [c for c in ("has_updated", "has_deleted", "required") if c not in registry.columns]
    default = {"has_updated": F.lit(True), "has_deleted": F.lit(True), "required": F.array().cast("array<string>")}
    known = registry.select("*", F.lit(True).alias("synced"), *[default[c].alias(c) for c in held])
    met = mutations.join(small(known), "table_name", "left").join(rows.select(*RECORD, "updated", "deleted", F.lit(True).alias("here")), RECORD, "left")
    here, gone = F.coalesce("here", F.lit(False)), F.coalesce("deleted", F.lit(False))
    op = F.when(F.col("op") == "upsert", F.when(here, "update").otherwise("insert")).otherwise(F.col("op"))
    winner, why = last_write(F.col("client_time"), F.col("updated"), F.col("base"), tolerance, now)
    late = F.coalesce("has_updated", F.lit(False)) & F.col("updated").isNotNull() & (winner == "server")
    bare = (F.size("columns") == 0) if "columns" in mutations.columns else F.lit(False)
    lacks = F.array_except("required", "filled") if "filled" in mutations.columns else F.array().cast("array<string>")
    insert, update, delete = op == "insert", op == "update", op == "delete"
    result = lambda status, code, message, action: F.struct(
        F.lit(status).alias("status"), F.lit(code).cast("string").alias("code"), (message if isinstance(message, Column) else F.lit(message)).cast("string").alias("message"), F.lit(action).cast("string").alias("action")
    )
    done = lambda action: result("applied", None, None, action)
    conflict = lambda message: result("conflict", "version_conflict", message, None)
    invalid = lambda message: result("rejected_terminal", "validation_failed", message, None)
    outcome = (
        F.when(F.col("synced").isNull(), result("rejected_terminal", "table_not_synced", "table is not synced", None))
        .when(F.col("push_policy") == "read_only", result("rejected_terminal", "policy_rejected", "table is read only", None))
        .when(insert & here & ~gone, conflict("record already exists"))
        .when(insert & here & late, conflict(why)).when(insert & here, done("resurrect"))
        .when(insert & bare, invalid("no allowed columns for insert"))
        .when(insert & (F.size(lacks) > 0), invalid(F.concat(F.lit("missing required column "), F.element_at(lacks, 1)))).when(insert, done("insert"))
        .when(update & ~here, invalid("record does not exist")).when(update & gone, conflict("record has been deleted"))
        .when(update & late, conflict(why)).when(update & bare, done("keep")).when(update, done("update"))
        .when(delete & ~F.col("has_deleted"), done("remove")).when(delete & ~here, invalid("record does not exist"))
        .when(delete & gone, done("keep")).when(delete, done("delete"))
        .otherwise(invalid("unknown operation"))
    )
    return met.withColumn("op", op).withColumn("outcome", outcome).select(*mutations.columns, "outcome.*")


def stripped(payload: Column, columns: list[str]) -> Column:
    """A JSON payload as a map of text without the keys that a client may not write."""
    return F.map_filter(F.from_json(payload, "map<string,string>"), lambda k, _: k.isin(columns))


def hooked(mutations: DataFrame, hook: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """``mutations`` (mutation_id, payload, ...) after a policy ``hook``, with column ``refused``.

    The hook takes the mutations and gives (mutation_id, payload, error): it may change a payload, or refuse one by an error or by giving
    none. What it gives is stripped again, so it can't bring in columns that a client may not write.
    """
    told = hook(mutations).select("mutation_id", F.col("payload").alias("_given"), F.col("error").alias("_error"))
    met = mutations.join(told, "mutation_id", "left")
    refused = F.when(F.col("_error").isNotNull(), F.col("_error")).when(F.col("_given").isNull(), "rejected by policy")
    return met.withColumn("payload", F.to_json(stripped(F.col("_given"), columns))).withColumn("refused", refused).drop("_given", "_error")


def required_columns(schema: T.StructType, synced: list[str], protected: list[str]) -> list[str]:
    """Synced columns that take no null and have no default, but for the protected ones."""
    return [f.name for f in schema if f.name in synced and f.name not in protected and not f.nullable and "CURRENT_DEFAULT" not in f.metadata]


def canonical_id(key: Column, kind: T.DataType | str) -> Column:
    """A record id as its key's type writes it (a UUID in lower case, a number without leading zeros); null if it is none of that type."""
    if kind == "uuid":
        plain = F.lower(F.trim(key))
        return F.when(plain.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), plain)
    return key.try_cast(kind).cast("string")


def written(table: DataFrame, outcomes: DataFrame, pk: str, columns: list[str], updated_at: str | None, deleted_at: str | None, now: Column) -> DataFrame:
    """``table`` after ``outcomes`` (record_id, action, client_time, payload: JSON) of :func:`resolve`; one for each record.

    Of a payload's keys those in ``columns`` are written, as the column's type; a key that is absent leaves the value, a null sets null. The update
    time becomes the client's, in milliseconds; a resurrected row loses its deletion time, a deleted one gets ``now`` there or goes.
    """
    schema = T.StructType([f for f in table.schema if f.name in columns])
    live = outcomes.filter("action in ('insert', 'update', 'resurrect', 'delete', 'remove')").select(
        F.col("record_id").alias("_id"), F.col("action").alias("_action"), F.col("client_time").alias("_time"), "payload"
    )
    live = live.withColumn("_new", F.from_json("payload", schema)).withColumn("_keys", F.coalesce(F.expr("json_object_keys(payload)"), F.array().cast("array<string>"))).drop("payload")
    met = table.join(live, table[pk].cast("string") == F.col("_id"), "full").filter("_action is null or _action <> 'remove'")
    writes, kinds = F.col("_action").isin("insert", "update", "resurrect"), {f.name: f.dataType for f in table.schema}
    out = []
    for c in table.columns:
        value = F.col(c)
        if c == pk:
            value = F.coalesce(value, F.col("_id").cast(kinds[c]))
        elif c in columns:
            value = F.when(writes & F.array_contains("_keys", c), F.col("_new")[c]).otherwise(value)
        elif c == updated_at:
            value = F.when(writes & F.col("_time").isNotNull(), F.timestamp_millis("_time").cast(kinds[c])).otherwise(value)
        elif c == deleted_at:
            value = F.when(F.col("_action") == "delete", now.cast(kinds[c])).when(F.col("_action") != "resurrect", value).when(F.col("_action").isNull(), value)
        out.append(value.alias(c))
    return met.select(*out)


def in_rounds(mutations: DataFrame, order: str = "position") -> DataFrame:
    """Mutations with the round in which each can go: the first of every record in round 1, the next in round 2 ..."""
    return mutations.withColumn("round", F.row_number().over(Window.partitionBy("table_name", "record_id").orderBy(order)))


def allowed_columns(payload: Column, synced: list[str], protected: list[str]) -> Column:
    """Payload keys that a client may write, in synced order."""
    keep = F.array(*[F.lit(c) for c in synced if c not in protected])
    return F.array_intersect(keep, payload)


def newer_only(incoming: DataFrame, local: DataFrame) -> DataFrame:
    """Rows of ``incoming`` (record_id, version) that are absent from ``local`` or newer there."""
    met = incoming.alias("i").join(local.select("record_id", F.col("version").alias("held")), "record_id", "left")
    return met.filter("held is null or held < version").select("record_id", "version")


def orphans(rows: DataFrame, provenance: DataFrame) -> DataFrame:
    """Rows that no scope holds any more."""
    return rows.join(provenance, ["table_name", "record_id"], "left_anti")


def prune_generation(scope_rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """Scope rows of the scope's present generation."""
    return scope_rows.join(scopes.select("scope_id", "generation"), ["scope_id", "generation"], "left_semi")


def verified(local: DataFrame, server: DataFrame) -> DataFrame:
    """(scope_id, matches): a scope whose checksums differ has its cursor cleared and is rebuilt."""
    met = server.join(local.select("scope_id", F.col("checksum").alias("own")), "scope_id", "left")
    return met.select("scope_id", (F.coalesce("own", F.lit(0)) == F.col("checksum")).alias("matches"))


def shifted(scopes: DataFrame, changes: DataFrame) -> DataFrame:
    """Scope checksums after ``changes`` (scope_id, old, new): XOR of what went and what came, without a rescan."""
    delta = changes.groupBy("scope_id").agg(F.bit_xor(F.coalesce("old", F.lit(0)).bitwiseXOR(F.coalesce("new", F.lit(0)))).alias("delta"))
    met = scopes.join(delta, "scope_id", "left")
    return met.select("scope_id", F.col("checksum").bitwiseXOR(F.coalesce("delta", F.lit(0))).alias("checksum"))


def upsert_rejected(held: DataFrame, new: DataFrame) -> DataFrame:
    """Rejections by mutation_id; a repeated one takes the new status and keeps its first time."""
    old = held.select("mutation_id", F.col("created").alias("first"))
    fresh = new.join(old, "mutation_id", "left").withColumn("created", F.coalesce("first", "created")).select(*held.columns)
    return held.join(new, "mutation_id", "left_anti").select(*held.columns).union(fresh)


#: The queued operation, the incoming one, what is queued then (None: nothing).
FOLD = {
    (None, "insert"): "create", ("delete", "insert"): "update", ("create", "insert"): "create", ("update", "insert"): "update",
    (None, "update"): "update", (None, "delete"): "delete", ("create", "update"): "create", ("create", "delete"): None,
    ("update", "delete"): "delete", ("delete", "update"): "update", ("update", "update"): "update", ("delete", "delete"): "delete",
}


#: Queued states: the operation, and whether its base version is known. A queued delete always has one.
STATES = (None, ("create", False), ("create", True), ("update", False), ("update", True), ("delete", True))
KINDS = ("insert", "update", "delete")


def step(state: tuple[str, bool] | None, kind: str, known: bool) -> tuple[tuple[str, bool] | None, str]:
    """The state after an edit whose old version is ``known`` or not, and where the base comes from: keep, old or none."""
    op, based = state or (None, False)
    after = FOLD[op, kind]
    base = "keep" if based or kind == "insert" else "old" if known else "none"
    base = "none" if op is None and kind == "insert" else base
    has = based if base == "keep" else known if base == "old" else False
    if after is None or (after == "delete" and kind != "insert" and not has):
        return None, "none"
    return (after, has), base


def fold_local(changes: DataFrame, slice_size: int = 10_000) -> DataFrame:
    """The pending queue after local ``changes`` (table_name, record_id, position, kind, old_version, at): one row per record still queued.

    The fold is sequential within a record, but what a run of edits does to each state that can be queued composes. So a record's
    edits are cut into slices of ``slice_size`` positions, each slice is folded from all six states at once, and the slices' results
    are folded in order: no task holds more of a record than a slice (positions tell edits apart) and a row for each slice.
    """
    table = [[[step(s, k, known) for known in (False, True)] for k in KINDS] for s in STATES]
    at = {s: i for i, s in enumerate(STATES)}
    flat = [table[s][k][known] for s in range(len(STATES)) for k in range(len(KINDS)) for known in (0, 1)]
    following = F.array(*[F.lit(at[after]) for after, _ in flat])
    bases = F.array(*[F.lit({"keep": 0, "old": 1, "none": 2}[base]) for _, base in flat])
    kind = reduce(lambda c, k: c.when(F.col("kind") == k, KINDS.index(k)), KINDS[1:], F.when(F.col("kind") == KINDS[0], 0))
    edit = F.struct("position", kind.alias("kind"), F.col("old_version").cast("long").alias("old"), F.col("at").cast("long").alias("at"))
    sliced = changes.groupBy(*RECORD, F.floor(F.col("position") / slice_size).alias("slice")).agg(F.array_sort(F.collect_list(edit)).alias("edits"))
    # a way through a slice: the state it ends in, whether the base that came in is still there, and the base otherwise
    ways = F.array(*[F.struct(F.lit(i).alias("state"), F.lit(True).alias("kept"), F.lit(None).cast("long").alias("base")) for i in range(len(STATES))])

    def move(way: Column, e: Column) -> Column:
        cell = way["state"] * 6 + e["kind"] * 2 + e["old"].isNotNull().cast("int") + 1
        source = F.element_at(bases, cell)
        base = F.when(source == 0, way["base"]).when(source == 1, e["old"])
        return F.struct(F.element_at(following, cell).alias("state"), (way["kept"] & (source == 0)).alias("kept"), base.alias("base"))

    through = F.aggregate("edits", ways, lambda held, e: F.transform(held, lambda w: move(w, e)))
    parts = sliced.select(*RECORD, F.struct("slice", through.alias("ways"), F.element_at("edits", -1)["at"].alias("at")).alias("part"))
    start = F.struct(F.lit(0).alias("state"), F.lit(None).cast("long").alias("base"))

    def cross(state: Column, part: Column) -> Column:
        way = F.element_at(part["ways"], state["state"] + 1)
        return F.struct(way["state"].alias("state"), F.when(way["kept"], state["base"]).otherwise(way["base"]).alias("base"))

    whole = parts.groupBy(*RECORD).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    ended = whole.select(*RECORD, F.aggregate("parts", start, cross).alias("end"), F.element_at("parts", -1)["at"].alias("at"))
    names = F.array(*[F.lit(s[0] if s else None).cast("string") for s in STATES])
    return ended.filter("end.state > 0").select(
        *RECORD, F.element_at(names, F.col("end.state") + 1).alias("operation"), F.col("end.base").alias("base_version"), F.col("at").alias("client_version")
    )


def pending(queue: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` queued changes, oldest client version first, with their rank."""
    first = queue.orderBy("client_version", *RECORD).limit(limit)
    return first.withColumn("rank", F.row_number().over(Window.orderBy("client_version", *RECORD)))  # over at most limit rows


def batch_id(mutations: DataFrame) -> DataFrame:
    """One row: the first and the last mutation id in order, ``empty`` without any."""
    ends = mutations.agg(F.min_by("mutation_id", F.struct("client_version", "mutation_id")).alias("a"), F.max_by("mutation_id", F.struct("client_version", "mutation_id")).alias("b"))
    return ends.select(F.coalesce(F.concat("a", F.lit("|"), "b"), F.lit("empty")).alias("batch_id"))


def batches(rows: Iterator) -> list:
    """Push batches of at most 100 mutations."""
    every = list(rows)
    return [every[i : i + 100] for i in range(0, len(every), 100)]
