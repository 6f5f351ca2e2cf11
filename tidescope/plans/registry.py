"""Queries of the change-data operators over the test tables, and their SQL.

The test tables have no owners, versions or deletions: those are derived from keys, the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescope.functions import rules, types
from tidescope.functions.canonical import deterministic_uuid, row_json, row_version, signed_crc32, version_text
from tidescope.operators import changelog, client, contract, registry, scopes, serve, writes
from tidescope.sources import change_log, line_id, read, scope_of_customer, surrogate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


LOG = """log AS (SELECT event_id + 1 AS seq, 'user:' || CAST(user_id AS VARCHAR) AS scope_id, 'items' AS table_name, CAST(event_id % 200 AS VARCHAR) AS record_id,
    CAST(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 3 ELSE 2 END AS INTEGER) AS operation FROM events)"""
SCOPE = "'user:' || CAST(c_custkey % 16 AS VARCHAR)"
SUM = "(({}) * 2654435761) % 2147483647"


# --- scopes -----------------------------------------------------------------------------------------------------------


def customer_members(spark, sf):
    return scopes.owned(read(spark, sf, "customer"), F.col("c_custkey"), scope_of_customer(F.col("c_custkey")))


def order_members(spark, sf):
    customers = read(spark, sf, "customer").select("c_custkey")
    return scopes.chained(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey"), [(customers, "o_custkey", "c_custkey")], scope_of_customer(F.col("c_custkey")))


def line_members(spark, sf):
    lines = read(spark, sf, "lineitem").select(line_id().alias("line"), "l_orderkey")
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customers = read(spark, sf, "customer").select("c_custkey")
    return scopes.chained(lines, F.col("line"), [(orders, "l_orderkey", "o_orderkey"), (customers, "o_custkey", "c_custkey")], scope_of_customer(F.col("c_custkey")), unique=False)


def order_edges(spark, sf):
    sums = read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("record_id"), surrogate(F.col("o_orderkey")).alias("checksum"))
    return scopes.edges("orders", order_members(spark, sf), sums)


def all_edges(spark, sf):
    own = read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("record_id"), surrogate(F.col("c_custkey")).alias("checksum"))
    both = scopes.edges("customer", customer_members(spark, sf), own).union(order_edges(spark, sf))
    for name, pk in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("supplier", "s_suppkey"), ("part", "p_partkey")):
        t = read(spark, sf, name)
        sums = t.select(F.col(pk).cast("string").alias("record_id"), surrogate(F.col(pk).cast("long")).alias("checksum"))
        both = both.union(scopes.edges(name, scopes.constant(t, F.col(pk), "global"), sums))
    return both


EDGES = f"""edges AS (
    SELECT 'customer' AS table_name, CAST(c_custkey AS VARCHAR) AS record_id, {SCOPE} AS scope_id, {SUM.format('c_custkey')} AS checksum FROM customer
    UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), {SCOPE}, {SUM.format('o_orderkey')} FROM orders JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), 'global', {SUM.format('CAST(r_regionkey AS BIGINT)')} FROM region
    UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), 'global', {SUM.format('CAST(n_nationkey AS BIGINT)')} FROM nation
    UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), 'global', {SUM.format('CAST(s_suppkey AS BIGINT)')} FROM supplier
    UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), 'global', {SUM.format('CAST(p_partkey AS BIGINT)')} FROM part)"""


@query("SELECT CAST(n_nationkey AS VARCHAR) AS record_id, 'global' AS scope_id FROM nation")
def scope_resolve_constant(spark, sf):
    return scopes.constant(read(spark, sf, "nation"), F.col("n_nationkey"), "global")


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS record_id, {SCOPE} AS scope_id FROM customer")
def scope_resolve_owner(spark, sf):
    return customer_members(spark, sf)


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS record_id, {SCOPE} AS scope_id FROM orders JOIN customer ON o_custkey = c_custkey")
def scope_resolve_chain1(spark, sf):
    return order_members(spark, sf)


@query(f"""SELECT DISTINCT CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) || ':' || CAST(l_suppkey AS VARCHAR) || ':' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS record_id,
    {SCOPE} AS scope_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""")
def scope_resolve_chain2(spark, sf):
    return line_members(spark, sf)


@query("SELECT DISTINCT CAST(conv_id AS VARCHAR) AS record_id, 'role:' || role AS scope_id FROM conversations WHERE role <> ''")
def scope_resolve_multi_member(spark, sf):
    turns = read(spark, sf, "conversations")
    return scopes.owned(turns, F.col("conv_id"), F.concat(F.lit("role:"), "role"), unique=False)


@query("SELECT CAST(doc_id AS VARCHAR) AS record_id, 'source:' || source AS scope_id FROM documents UNION SELECT CAST(doc_id AS VARCHAR), 'lang:' || lang FROM documents")
def scope_resolve_two_paths(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "source", "lang")
    return scopes.either(*[docs.select(F.col("doc_id").cast("string").alias("record_id"), F.concat(F.lit(f"{c}:"), c).alias("scope_id")) for c in ("source", "lang")])


@query(f"WITH {EDGES} SELECT table_name, record_id, scope_id, checksum FROM edges")
def edges_backfill(spark, sf):
    return all_edges(spark, sf)


@query(f"WITH {EDGES} SELECT scope_id, bit_xor(checksum) AS checksum, count(*) AS members FROM edges GROUP BY scope_id")
def scope_checksum_xor(spark, sf):
    return scopes.checksums(all_edges(spark, sf))


@query(f"WITH {EDGES} SELECT scope_id, table_name, count(*) AS members FROM edges GROUP BY ALL")
def scope_member_counts(spark, sf):
    return all_edges(spark, sf).groupBy("scope_id", "table_name").agg(F.count("*").alias("members"))


#: Tables of the summary: key, scope, and the columns by kind (n: number, s: text, t: time), from which SQL builds the canonical text.
SUMMED = {
    "customer": ("c_custkey", SCOPE, {"c_custkey": "n", "c_name": "s", "c_nationkey": "n", "c_acctbal": "n", "c_mktsegment": "s"}),
    "orders": ("o_orderkey", SCOPE, {"o_orderkey": "n", "o_custkey": "n", "o_orderstatus": "s", "o_totalprice": "n", "o_orderdate": "t", "o_orderpriority": "s"}),
    "region": ("r_regionkey", "'global'", {"r_regionkey": "n", "r_name": "s"}),
    "nation": ("n_nationkey", "'global'", {"n_nationkey": "n", "n_name": "s", "n_regionkey": "n"}),
    "supplier": ("s_suppkey", "'global'", {"s_suppkey": "n", "s_name": "s", "s_nationkey": "n", "s_acctbal": "n"}),
    "part": ("p_partkey", "'global'", {"p_partkey": "n", "p_name": "s", "p_brand": "s", "p_type": "s", "p_size": "n", "p_retailprice": "n"}),
}


def sql_json(columns: dict[str, str]) -> str:
    shown = {"n": "CAST({} AS VARCHAR)", "s": "'\"' || {} || '\"'", "t": "'\"' || strftime({}, '%Y-%m-%dT%H:%M:%S.000') || '\"'"}
    return "'{' || " + " || ',' || ".join(f"'\"{c}\":' || coalesce({shown[k].format(c)}, 'null')" for c, k in sorted(columns.items())) + " || '}'"


#: CRC-32 by its table of 256 remainders, byte by byte.
SQL_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(j, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"""
SUMMED_SQL = " UNION ALL ".join(f"SELECT {scope} AS scope_id, {sql_json(columns)} AS j FROM {name}{' JOIN customer ON o_custkey = c_custkey' * (name == 'orders')}" for name, (_, scope, columns) in SUMMED.items())


@query(f"""WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
    x AS ({SUMMED_SQL}), y AS (SELECT scope_id, {SQL_CRC} AS c FROM x, tab)
    SELECT scope_id, CAST(bit_xor(CASE WHEN c >= 2147483648 THEN c - 4294967296 ELSE c END) AS INTEGER) AS checksum, count(*) AS members FROM y GROUP BY scope_id""")
def scope_summary(spark, sf):
    """Members and row checksums (CRC-32 of canonical JSON) of every scope."""
    out = None
    for name, (pk, _, _) in SUMMED.items():
        t = read(spark, sf, name)
        sums = t.select(F.col(pk).cast("string").alias("record_id"), signed_crc32(row_json(t.columns)).alias("checksum"))
        members = {"customer": customer_members, "orders": order_members}.get(name, lambda spark, sf, t=t, pk=pk: scopes.constant(t, F.col(pk), "global"))
        e = scopes.edges(name, members(spark, sf), sums)
        out = e if out is None else out.union(e)
    return scopes.checksums(out)


# --- edge differences: every order whose key is a multiple of 7 moves to the next user, of 11 is deleted, of 13 is new ------

OLD = "old AS (SELECT 'orders' AS table_name, record_id, scope_id FROM edges WHERE table_name = 'orders' AND CAST(record_id AS BIGINT) % 13 <> 0)"
NEW = """new AS (SELECT 'orders' AS table_name, CAST(o_orderkey AS VARCHAR) AS record_id, 'user:' || CAST((c_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) % 16 AS VARCHAR) AS scope_id
    FROM orders JOIN customer ON o_custkey = c_custkey)"""
DIFF = """diff AS (SELECT coalesce(o.table_name, n.table_name) AS table_name, coalesce(o.record_id, n.record_id) AS record_id, coalesce(o.scope_id, n.scope_id) AS scope_id,
    CASE WHEN o.scope_id IS NULL THEN 'added' WHEN n.scope_id IS NULL THEN 'removed' ELSE 'kept' END AS change
    FROM old o FULL JOIN new n ON o.table_name = n.table_name AND o.record_id = n.record_id AND o.scope_id = n.scope_id)"""


def old_edges(spark, sf):
    return order_edges(spark, sf).filter(F.col("record_id").cast("long") % 13 != 0)


def new_edges(spark, sf):
    moved = F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)
    customers = read(spark, sf, "customer").select("c_custkey")
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return orders.select(F.lit("orders").alias("table_name"), F.col("o_orderkey").cast("string").alias("record_id"), scope_of_customer(F.col("c_custkey") + moved).alias("scope_id"), surrogate(F.col("o_orderkey")).alias("checksum"))


def order_events(spark, sf):
    k = F.col("o_orderkey")
    op = F.when(k % 11 == 0, 3).when(k % 13 == 0, 1).otherwise(2)
    return read(spark, sf, "orders").select(F.lit("orders").alias("table_name"), k.cast("string").alias("record_id"), op.alias("operation"))


@query(f"WITH {EDGES}, {OLD}, {NEW}, {DIFF} SELECT table_name, record_id, scope_id, change FROM diff")
def set_diff_added_kept_removed(spark, sf):
    return scopes.difference(old_edges(spark, sf), new_edges(spark, sf))


@query(f"""WITH {EDGES}, {OLD}, {NEW}, {DIFF}, has AS (SELECT DISTINCT record_id FROM old)
    SELECT d.table_name, d.record_id, d.scope_id, CAST(CASE WHEN o_orderkey % 11 = 0 THEN 3 WHEN change = 'added' THEN 1 WHEN change = 'removed' THEN 3 ELSE 2 END AS INTEGER) AS operation
    FROM diff d JOIN orders ON d.record_id = CAST(o_orderkey AS VARCHAR) LEFT JOIN has h ON h.record_id = d.record_id
    WHERE NOT (o_orderkey % 11 = 0 AND h.record_id IS NOT NULL AND change = 'added')""")
def edge_diff_entries(spark, sf):
    return scopes.diff_entries(order_events(spark, sf), old_edges(spark, sf), new_edges(spark, sf))


@query(f"""WITH {NEW} SELECT table_name, record_id, scope_id, {SUM.format('CAST(record_id AS BIGINT)')} AS checksum FROM new WHERE CAST(record_id AS BIGINT) % 11 <> 0""")
def edges_apply_events(spark, sf):
    return scopes.apply_events(old_edges(spark, sf), order_events(spark, sf), new_edges(spark, sf))


# --- change log -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {LOG}, k AS (SELECT table_name, record_id, min(seq) AS position, max(seq) AS seq FROM log GROUP BY ALL)
    SELECT k.table_name, k.record_id, log.scope_id, log.operation, k.seq, k.position FROM k JOIN log USING (table_name, record_id, seq)""")
def changelog_dedup(spark, sf):
    return changelog.dedup(change_log(spark, sf))


@query(f"""WITH {LOG}, k AS (SELECT table_name, record_id, scope_id, min(seq) AS position, max(seq) AS seq FROM log GROUP BY ALL)
    SELECT k.table_name, k.record_id, k.scope_id, log.operation, k.seq, k.position FROM k JOIN log USING (table_name, record_id, scope_id, seq)""")
def changelog_dedup_by_scope(spark, sf):
    return changelog.dedup(change_log(spark, sf), by_scope=True)


@query("SELECT row_number() OVER (ORDER BY event_id) + 1000 AS seq, event_id, event_type FROM events")
def changelog_append(spark, sf):
    return changelog.append(read(spark, sf, "events").select("event_id", "event_type"), ["event_id"], 1000)


CURSORS = "cursors AS (SELECT DISTINCT 'user:' || CAST(user_id AS VARCHAR) AS scope_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 50 END AS checkpoint FROM events)"


def cursors(spark, sf):
    u = F.col("user_id")
    return read(spark, sf, "events").select(F.concat(F.lit("user:"), u.cast("string")).alias("scope_id"), F.when(u % 3 != 0, u % 50).alias("checkpoint")).distinct()


PAGE = f"""WITH {LOG}, {CURSORS}, f AS (SELECT log.* FROM log JOIN cursors USING (scope_id) WHERE seq > coalesce(checkpoint, 0)),
    r AS (SELECT *, CAST(row_number() OVER (ORDER BY seq, scope_id) AS INTEGER) AS rank, count(*) OVER () > 100 AS has_more FROM f)"""


@query(PAGE + " SELECT seq, scope_id, table_name, record_id, operation, rank, has_more FROM r WHERE rank <= 100")
def pull_page(spark, sf):
    return changelog.page(change_log(spark, sf), cursors(spark, sf), rules.clamp(0))


@query(f"WITH {LOG}, {CURSORS} SELECT seq, scope_id, table_name, record_id, operation FROM log JOIN cursors USING (scope_id) WHERE seq > coalesce(checkpoint, 0)")
def pull_per_scope_filter(spark, sf):
    log = change_log(spark, sf)
    return log.join(cursors(spark, sf), "scope_id").filter(F.col("seq") > F.coalesce("checkpoint", F.lit(0))).select(*log.columns)


@query(f"WITH {CURSORS} SELECT CAST(min(coalesce(checkpoint, 0)) AS BIGINT) AS effective FROM cursors")
def pull_effective_checkpoint(spark, sf):
    return cursors(spark, sf).agg(F.min(F.coalesce("checkpoint", F.lit(0))).cast("long").alias("effective"))


@query(f"""WITH {LOG}, k AS (SELECT table_name, record_id, max(seq) AS seq FROM log GROUP BY ALL), e AS (SELECT log.* FROM k JOIN log USING (table_name, record_id, seq))
    SELECT e.scope_id, e.table_name, e.record_id, '{{"p_partkey":"' || e.record_id || '"}}' AS pk, CASE WHEN operation = 3 THEN 'delete' ELSE 'upsert' END AS op, e.seq,
        p_name AS row_json, coalesce(CAST(p_size AS VARCHAR), CAST(e.seq AS VARCHAR)) AS version, {SUM.format('p_partkey')} AS checksum
    FROM e LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = e.record_id WHERE operation = 3 OR p_name IS NOT NULL""")
def pull_change_records(spark, sf):
    """Deletes bring their row where it is still there: as a tombstone."""
    k = F.col("p_partkey")
    rows = read(spark, sf, "part").select(F.lit("items").alias("table_name"), k.cast("string").alias("record_id"), F.col("p_name").alias("row_json"), F.col("p_size").cast("string").alias("row_version"), surrogate(k.cast("long")).alias("checksum"))
    return serve.change_records(changelog.dedup(change_log(spark, sf)), rows, {"items": "p_partkey"})


@query(f"""WITH {LOG}, late AS (SELECT * FROM log WHERE seq > 20), c AS (SELECT DISTINCT 'user:' || CAST(user_id AS VARCHAR) AS scope_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 50 END AS checkpoint FROM events)
    SELECT scope_id FROM c WHERE checkpoint IS NULL OR (checkpoint > 0 AND checkpoint < (SELECT min(seq) FROM late))""")
def stale_scopes(spark, sf):
    u = F.col("user_id")
    every = read(spark, sf, "events").select(F.concat(F.lit("user:"), u.cast("string")).alias("scope_id"), F.when(u % 3 != 0, u % 50).alias("checkpoint")).distinct()
    return changelog.stale_scopes(every, change_log(spark, sf).filter("seq > 20"))


@query(f"WITH {LOG} SELECT coalesce(min(seq), 0) AS min_seq, coalesce(max(seq), 0) AS max_seq, count(*) AS total FROM log")
def changelog_stats(spark, sf):
    return changelog.stats(change_log(spark, sf))


CLIENTS = "clients AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id, 'c' || CAST(c_custkey AS VARCHAR) AS client_id, c_custkey % 5 <> 0 AS is_active, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey * 1000 END AS last_sync FROM customer)"
POINTS = "points AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id, 'c' || CAST(c_custkey AS VARCHAR) AS client_id, 100 + c_custkey % 400 AS checkpoint FROM customer)"


def clients(spark, sf):
    k = F.col("c_custkey")
    return read(spark, sf, "customer").select(k.cast("string").alias("user_id"), F.concat(F.lit("c"), k.cast("string")).alias("client_id"), (k % 5 != 0).alias("is_active"), F.when(k % 7 != 0, k * 1000).alias("last_sync"))


def safe(spark, sf):
    k = F.col("c_custkey")
    points = read(spark, sf, "customer").select(k.cast("string").alias("user_id"), F.concat(F.lit("c"), k.cast("string")).alias("client_id"), (k % 400 + 100).alias("checkpoint"))
    return changelog.safe_seq(clients(spark, sf), points, change_log(spark, sf))


@query(f"WITH {CLIENTS} SELECT user_id, client_id FROM clients WHERE is_active AND last_sync < 1000000 - 400000")
def compact_deactivate(spark, sf):
    return changelog.deactivated(clients(spark, sf), 1_000_000, 400_000)


@query(f"WITH {CLIENTS}, {POINTS} SELECT min(checkpoint) AS safe_seq FROM points JOIN clients USING (user_id, client_id) WHERE is_active")
def compact_safe_seq(spark, sf):
    return safe(spark, sf)


@query(f"WITH {LOG}, {CLIENTS}, {POINTS}, s AS (SELECT min(checkpoint) AS safe_seq FROM points JOIN clients USING (user_id, client_id) WHERE is_active) SELECT log.* FROM log, s WHERE seq > safe_seq")
def compact_retained(spark, sf):
    return changelog.compact(change_log(spark, sf), safe(spark, sf))


# --- serving --------------------------------------------------------------------------------------------------------------


@query(f"WITH {EDGES} SELECT table_name, record_id, checksum FROM edges WHERE scope_id = 'user:3' ORDER BY table_name, record_id LIMIT 100")
def rebuild_page_first(spark, sf):
    return serve.scope_page(all_edges(spark, sf), "user:3", None, 100)


@query(f"WITH {EDGES} SELECT table_name, record_id, checksum FROM edges WHERE scope_id = 'user:3' AND (table_name > 'customer' OR (table_name = 'customer' AND record_id > '5')) ORDER BY table_name, record_id LIMIT 100")
def rebuild_page_keyset(spark, sf):
    return serve.scope_page(all_edges(spark, sf), "user:3", "customer|5", 100)


@query(f"WITH {EDGES} SELECT scope_id, table_name, record_id, o_orderpriority AS row_json FROM edges JOIN orders ON table_name = 'orders' AND record_id = CAST(o_orderkey AS VARCHAR) WHERE o_orderstatus <> 'F'")
def rebuild_snapshot(spark, sf):
    rows = read(spark, sf, "orders").select(F.lit("orders").alias("table_name"), F.col("o_orderkey").cast("string").alias("record_id"), F.col("o_orderpriority").alias("row_json"), (F.col("o_orderstatus") == "F").alias("deleted"))
    return serve.snapshot(all_edges(spark, sf), rows)


@query("""SELECT CAST(c_custkey AS VARCHAR) AS user_id, 'user:' || CAST(c_custkey AS VARCHAR) || ',global,shared:1' AS scopes, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END AS scope_set_version FROM customer""")
def ensure_client_scopes(spark, sf):
    k = F.col("c_custkey")
    own = F.concat(F.lit("user:"), k.cast("string"))
    held = F.when(k % 2 == 0, F.array(own, F.lit("global"), F.lit("shared:1"))).otherwise(F.array(own))
    have = read(spark, sf, "customer").select(k.cast("string").alias("user_id"), F.lit("c").alias("client_id"), held.alias("scopes"), F.lit(1).alias("scope_set_version"))
    shared = spark.createDataFrame([("shared:1",), ("global",)], "scope_id string")
    return serve.ensured(have, shared).select("user_id", F.array_join("scopes", ",").alias("scopes"), F.col("scope_set_version").cast("int").alias("scope_set_version"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'global' ELSE 'global,extra' END AS added, CASE WHEN c_custkey % 2 = 0 THEN 'a,z' ELSE '' END AS removed FROM customer")
def scope_delta(spark, sf):
    k = F.col("c_custkey")
    own = F.concat(F.lit("user:"), k.cast("string"))
    known = F.when(k % 2 == 0, F.array(F.lit("z"), own, F.lit("a"))).otherwise(F.array(own))
    known = F.when(k % 3 == 0, F.array_append(known, "extra")).otherwise(known)
    add, remove = serve.scope_delta(known, F.array(own, F.lit("global"), F.lit("extra")))
    return read(spark, sf, "customer").select(k.cast("string").alias("user_id"), F.array_join(add, ",").alias("added"), F.array_join(remove, ",").alias("removed"))


@query(f"WITH {EDGES} SELECT table_name, record_id, scope_id, checksum, CAST(row_number() OVER (PARTITION BY scope_id, table_name ORDER BY record_id) AS INTEGER) AS position FROM edges WHERE scope_id = 'global'")
def seed_export(spark, sf):
    """Places of a scope's rows in its seed; no task sorts a whole scope."""
    placed = changelog.append(all_edges(spark, sf).filter("scope_id = 'global'"), ["record_id"], 0, ["scope_id", "table_name"])
    return placed.select("table_name", "record_id", "scope_id", "checksum", F.col("seq").cast("int").alias("position"))


# --- writes ----------------------------------------------------------------------------------------------------------------

DAYS = "date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))"
MUT = f"""m AS (SELECT CAST(o_orderkey AS VARCHAR) AS mutation_id, o_orderkey AS k, CAST({DAYS} AS BIGINT) * 86400000 AS t,
    CASE WHEN o_orderkey % 17 = 0 THEN 'nation' WHEN o_orderkey % 19 = 0 THEN 'nowhere' WHEN o_orderkey % 13 = 0 THEN 'part' ELSE 'orders' END AS table_name FROM orders)"""
LATER = 4_102_444_800_000


def mutations(spark, sf):
    """One mutation for every order. Some go to a read-only table, to one that isn't synced, or to one without deletion times and rows."""
    k = F.col("o_orderkey")
    t = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400000
    rows = read(spark, sf, "orders")
    table = F.when(k % 17 == 0, "nation").when(k % 19 == 0, "nowhere").when(k % 13 == 0, "part").otherwise("orders")
    op = F.element_at(F.array(F.lit("insert"), F.lit("update"), F.lit("delete"), F.lit("upsert")), (k % 4 + 1).cast("int"))
    named = F.when(k % 29 == 0, F.array().cast("array<string>")).when(k % 31 == 0, F.array(F.lit("name"))).otherwise(F.array(F.lit("name"), F.lit("note")))
    made = rows.select(
        k.cast("string").alias("mutation_id"), table.alias("table_name"), k.cast("string").alias("record_id"), op.alias("op"), F.when(k % 23 != 0, t + (k % 5 - 2) * 400).alias("client_time"),
        F.when(k % 3 == 0, t).when(k % 3 == 1, t - 1).alias("base"), named.alias("columns"), named.alias("filled"),
    )
    held = rows.filter(k % 6 != 0).select(F.lit("orders").alias("table_name"), k.cast("string").alias("record_id"), F.when(k % 10 != 3, t).alias("updated"), (k % 9 == 0).alias("deleted"))
    note = "array('note')"
    registry = spark.sql(f"SELECT * FROM VALUES ('orders', 'enabled', true, {note}), ('nation', 'read_only', true, {note}), ('part', 'enabled', false, {note}) AS t(table_name, push_policy, has_deleted, required)")
    return made, held, registry


@query(f"""WITH {MUT}, x AS (SELECT *, k % 6 <> 0 AND table_name = 'orders' AS here, k % 9 = 0 AS gone, k % 29 = 0 AS bare, k % 31 = 0 AS lacking,
        CASE WHEN k % 23 = 0 THEN {LATER} ELSE t + (k % 5 - 2) * 400 END AS ct FROM m),
    y AS (SELECT *, CASE k % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' WHEN 2 THEN 'delete' ELSE CASE WHEN here THEN 'update' ELSE 'insert' END END AS op,
        here AND k % 10 <> 3 AND k % 3 <> 0 AND ct + 500 <= t AS late FROM x),
    z AS (SELECT *, CASE WHEN table_name = 'nowhere' THEN 'table is not synced' WHEN table_name = 'nation' THEN 'table is read only'
        WHEN op = 'insert' AND here AND NOT gone THEN 'record already exists' WHEN op = 'insert' AND here AND late THEN 'server version is newer' WHEN op = 'insert' AND here THEN '+resurrect'
        WHEN op = 'insert' AND bare THEN 'no allowed columns for insert' WHEN op = 'insert' AND lacking THEN 'missing required column note' WHEN op = 'insert' THEN '+insert'
        WHEN op = 'update' AND NOT here THEN 'record does not exist' WHEN op = 'update' AND gone THEN 'record has been deleted' WHEN op = 'update' AND late THEN 'server version is newer'
        WHEN op = 'update' AND bare THEN '+keep' WHEN op = 'update' THEN '+update'
        WHEN table_name = 'part' THEN '+remove' WHEN NOT here THEN 'record does not exist' WHEN gone THEN '+keep' ELSE '+delete' END AS said FROM y)
    SELECT mutation_id, table_name, mutation_id AS record_id, op,
        CASE WHEN said LIKE '+%' THEN 'applied' WHEN said IN ('record already exists', 'server version is newer', 'record has been deleted') THEN 'conflict' ELSE 'rejected_terminal' END AS status,
        CASE WHEN said LIKE '+%' THEN NULL WHEN table_name = 'nowhere' THEN 'table_not_synced' WHEN table_name = 'nation' THEN 'policy_rejected'
            WHEN said IN ('record already exists', 'server version is newer', 'record has been deleted') THEN 'version_conflict' ELSE 'validation_failed' END AS code,
        CASE WHEN said NOT LIKE '+%' THEN said END AS message, CASE WHEN said LIKE '+%' THEN substr(said, 2) END AS action FROM z""")
def push_classify(spark, sf):
    made, held, registry = mutations(spark, sf)
    found = writes.resolve(made, held, registry, F.lit(LATER))
    return found.select("mutation_id", "table_name", "record_id", "op", "status", "code", "message", "action")


for _op in ("insert", "update", "delete"):
    _name = {"insert": "push_create"}.get(_op, f"push_{_op}")
    QUERIES[_name] = lambda spark, sf, op=_op: push_classify(spark, sf).filter(F.col("op") == op)
    ORACLE_SQL[_name] = f"SELECT * FROM ({ORACLE_SQL['push_classify']}) WHERE op = '{_op}'"


@query(f"SELECT mutation_id, op FROM ({ORACLE_SQL['push_classify']})")
def push_resolve_op(spark, sf):
    return push_classify(spark, sf).select("mutation_id", "op")


@query(f"""WITH {MUT} SELECT mutation_id, CASE k % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' WHEN 2 THEN 'delete' ELSE 'upsert' END AS op,
    CASE WHEN k % 5 = 0 THEN 'bad_base_version' WHEN k % 7 = 0 AND k % 4 <> 2 THEN 'no_client_version' WHEN k % 11 = 0 AND k % 7 <> 0 THEN 'bad_client_version' END AS violation FROM m""")
def contract_mutations(spark, sf):
    made, _, _ = mutations(spark, sf)
    k = F.col("mutation_id").cast("long")
    day = F.lit("2024-02-29T12:00:00.5+02:00")
    own = F.when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, "2024-02-30T00:00:00Z").otherwise(day)
    rows = made.select("mutation_id", "op", F.when(k % 5 == 0, "yesterday").when(k % 5 == 1, day).alias("base_version"), own.alias("client_version"))
    return contract.mutations(rows).select("mutation_id", "op", "violation")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS user_id, CASE c_custkey % 4 WHEN 0 THEN 'scope_added_twice' WHEN 1 THEN 'scope_added_and_removed' WHEN 2 THEN 'empty_scope' END AS violation FROM customer""")
def contract_scope_deltas(spark, sf):
    k = F.col("c_custkey")
    lists = lambda *x: F.array(*map(F.lit, x))
    add = F.when(k % 4 == 0, lists("a", "a")).when(k % 4 == 1, lists("a", "b")).otherwise(lists("a"))
    remove = F.when(k % 4 == 1, lists("b")).when(k % 4 == 2, lists("")).otherwise(lists("c"))
    rows = read(spark, sf, "customer").select(k.cast("string").alias("user_id"), add.alias("add"), remove.alias("remove"))
    return contract.deltas(rows).select("user_id", "violation")


@query("""SELECT * FROM (VALUES ('nation', 'n_comment', 'add_column'), ('customer', 'c_acctbal', 'retype'), ('orders', 'local_note', 'local_only'), ('part', 'p_partkey', 'add_table'), ('part', 'p_name', 'add_table')) t(table_name, column_name, change)""")
def schema_diff(spark, sf):
    """The test tables' manifest against one that a client might hold."""
    tables = {n: read(spark, sf, n) for n in ("nation", "customer", "orders", "part")}
    rows = [(r["table"], r["column"], types.STORAGE[r["type"]]) for r in serve.manifest(tables) if r["table"] != "part" or r["column"] in ("p_partkey", "p_name")]
    server = [*rows, ("nation", "n_comment", "TEXT")]
    local = [(t, c, "INTEGER" if c == "c_acctbal" else s) for t, c, s in rows if t != "part"] + [("orders", "local_note", "TEXT")]
    kinds = "table_name string, column_name string, storage string"
    return registry.schema_changes(spark.createDataFrame(local, kinds), spark.createDataFrame(server, kinds))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS record_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'held' END AS row_json FROM orders WHERE o_orderkey % 3 <> 1""")
def apply_page(spark, sf):
    """A client holds every order; the page updates even ones, deletes those with remainder 1 of 3."""
    k = F.col("o_orderkey")
    orders = read(spark, sf, "orders").select(k, "o_orderpriority")
    name, record = F.lit("orders").alias("table_name"), k.cast("string").alias("record_id")
    rows = orders.select(name, record, F.lit("held").alias("row_json"), F.lit(1).cast("long").alias("version"))
    held = orders.select(F.lit("s").alias("scope_id"), name, record, F.lit(7).alias("checksum"), F.lit(0).alias("generation"))
    scope = spark.createDataFrame([("s", "c", 7, 0)], "scope_id string, cursor string, checksum int, generation int")
    gone = k % 3 == 1
    page = orders.filter((k % 2 == 0) | gone).select(
        F.lit("s").alias("scope_id"), name, record, k.alias("seq"), F.when(gone, "delete").otherwise("upsert").alias("op"),
        F.when(~gone, F.col("o_orderpriority")).alias("row_json"), F.lit(2).cast("long").alias("version"), F.lit(9).alias("checksum"),
    )
    return client.apply_changes(rows, held, scope, page)[0].select("record_id", "row_json")


@query(f"""WITH {MUT}, x AS (SELECT *, k % 23 = 0 OR (k % 5 - 2) * 400 + 500 > 0 AS newer FROM m)
    SELECT mutation_id, CASE WHEN k % 3 = 0 OR newer THEN 'client' ELSE 'server' END AS winner,
    CASE WHEN k % 3 = 0 THEN 'server unchanged since base version' WHEN NOT newer THEN 'server version is newer' WHEN k % 3 = 1 THEN 'client timestamp newer (LWW with base)' ELSE 'client timestamp newer (LWW)' END AS reason FROM x""")
def push_lww(spark, sf):
    made, _, _ = mutations(spark, sf)
    k = F.col("mutation_id").cast("long")
    t = F.coalesce(F.col("client_time") - (k % 5 - 2) * 400, F.lit(0))
    winner, reason = rules.last_write(F.col("client_time"), t, F.when(k % 3 == 0, t).when(k % 3 == 1, t - 1), now=F.lit(LATER))
    return made.select("mutation_id", winner.alias("winner"), reason.alias("reason"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS record_id, CASE WHEN p_partkey % 2 = 0 THEN 'name,size' ELSE 'name' END AS columns FROM part")
def push_allowed_columns(spark, sf):
    k = F.col("p_partkey")
    payload = F.when(k % 2 == 0, F.array(*map(F.lit, ("size", "id", "name", "other")))).otherwise(F.array(*map(F.lit, ("name", "updated_at"))))
    keep = writes.allowed_columns(payload, ["id", "name", "size", "updated_at"], ["id", "updated_at"])
    return read(spark, sf, "part").select(k.cast("string").alias("record_id"), F.array_join(keep, ",").alias("columns"))


@query("SELECT CAST(event_id AS VARCHAR) AS record_id, CAST(CASE WHEN event_type = 'signup' THEN 1 WHEN event_type = 'error' OR (event_type = 'view' AND event_id % 10 = 0) THEN 3 ELSE 2 END AS INTEGER) AS operation FROM events")
def wal_soft_delete_decode(spark, sf):
    from tidescope.streaming import decode

    kind = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    gone = F.when((F.col("event_type") == "view") & (F.col("event_id") % 10 == 0), "x")
    raw = read(spark, sf, "events").select(kind.alias("kind"), F.lit("items").alias("table_name"), F.col("event_id").cast("string").alias("record_id"), gone.alias("deleted_at"))
    return decode(raw).select("record_id", "operation")


@query("""WITH RECURSIVE e AS (SELECT CAST(event_id % 200 AS VARCHAR) AS record_id, event_id AS moment, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS kind,
        CASE WHEN event_id % 7 <> 0 THEN event_id END AS old, row_number() OVER (PARTITION BY event_id % 200 ORDER BY event_id) AS n FROM events),
    f AS (SELECT record_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS op, CAST(NULL AS BIGINT) AS base, CAST(NULL AS BIGINT) AS moment FROM e WHERE e.n = 1
        UNION ALL SELECT record_id, n, CASE WHEN gone THEN NULL ELSE op END, CASE WHEN gone THEN NULL ELSE base END, moment FROM (
            SELECT *, op IS NULL OR (kind <> 'insert' AND op = 'delete' AND base IS NULL) AS gone FROM (
                SELECT f.record_id, e.n, e.kind, e.moment,
                    CASE WHEN f.op IS NULL THEN CASE e.kind WHEN 'insert' THEN 'create' ELSE e.kind END
                        WHEN f.op = 'create' THEN CASE e.kind WHEN 'delete' THEN NULL ELSE 'create' END
                        WHEN f.op = 'update' THEN CASE e.kind WHEN 'delete' THEN 'delete' ELSE 'update' END
                        ELSE CASE e.kind WHEN 'delete' THEN 'delete' ELSE 'update' END END AS op,
                    CASE WHEN f.op IS NULL THEN CASE WHEN e.kind <> 'insert' THEN e.old END WHEN e.kind = 'insert' THEN f.base ELSE coalesce(f.base, e.old) END AS base
                FROM f JOIN e ON e.record_id = f.record_id AND e.n = f.n + 1)))
    SELECT 'items' AS table_name, record_id, op AS operation, base AS base_version, moment AS client_version FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY n DESC) AS last FROM f) WHERE last = 1 AND op IS NOT NULL""")
def cdc_fold(spark, sf):
    """The queue after all events as local edits; every seventh has no old version."""
    e = F.col("event_id")
    kind = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    local = read(spark, sf, "events").select(F.lit("items").alias("table_name"), (e % 200).cast("string").alias("record_id"), e.alias("position"), kind.alias("kind"), F.when(e % 7 != 0, e).alias("old_version"), e.alias("at"))
    return writes.fold_local(local)


@query("SELECT mutation_id, rank FROM (SELECT CAST(event_id AS VARCHAR) AS mutation_id, CAST(row_number() OVER (ORDER BY value, event_id) AS INTEGER) AS rank FROM events) WHERE rank <= 100")
def pending_top_n(spark, sf):
    queue = read(spark, sf, "events").select(F.lit("items").alias("table_name"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("record_id"), F.col("value").alias("client_version"), F.col("event_id").cast("string").alias("mutation_id"))
    return writes.pending(queue, 100).select("mutation_id", "rank")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS record_id, o_orderkey % 10 AS version FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 7 < o_orderkey % 10")
def apply_version_guard(spark, sf):
    k = F.col("o_orderkey")
    rows = read(spark, sf, "orders")
    local = rows.filter(k % 4 != 0).select(k.cast("string").alias("record_id"), (k % 7).alias("version"))
    return writes.newer_only(rows.select(k.cast("string").alias("record_id"), (k % 10).alias("version")), local)


@query("SELECT 'orders' AS table_name, CAST(o_orderkey AS VARCHAR) AS record_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def apply_orphans(spark, sf):
    rows = read(spark, sf, "orders").select(F.lit("orders").alias("table_name"), F.col("o_orderkey").cast("string").alias("record_id"))
    held = read(spark, sf, "lineitem").select(F.lit("orders").alias("table_name"), F.col("l_orderkey").cast("string").alias("record_id"))
    return writes.orphans(rows, held)


@query("SELECT 'user:' || CAST(c_custkey % 16 AS VARCHAR) AS scope_id, CAST(c_custkey AS VARCHAR) AS record_id, c_custkey % 3 AS generation FROM customer WHERE c_custkey % 3 = (c_custkey % 16) % 3")
def scope_generation_prune(spark, sf):
    k = F.col("c_custkey")
    rows = read(spark, sf, "customer").select(scope_of_customer(k).alias("scope_id"), k.cast("string").alias("record_id"), (k % 3).alias("generation"))
    now = spark.range(16).select(F.concat(F.lit("user:"), F.col("id").cast("string")).alias("scope_id"), (F.col("id") % 3).alias("generation"))
    return writes.prune_generation(rows, now).select("scope_id", "record_id", "generation")


@query(f"WITH {EDGES}, s AS (SELECT scope_id, bit_xor(checksum) AS c FROM edges GROUP BY 1), l AS (SELECT scope_id, bit_xor(checksum) AS c FROM edges WHERE NOT (scope_id = 'user:5' AND record_id = '5') GROUP BY 1) SELECT scope_id, coalesce(l.c, 0) = s.c AS matches FROM s LEFT JOIN l USING (scope_id)")
def checksum_verify(spark, sf):
    e = all_edges(spark, sf)
    return writes.verified(scopes.checksums(e.filter("not (scope_id = 'user:5' and record_id = '5')")), scopes.checksums(e))


@query(f"WITH {EDGES} SELECT scope_id, bit_xor(CASE WHEN checksum % 2 = 0 THEN checksum + 1 ELSE checksum END) AS checksum FROM edges GROUP BY scope_id")
def checksum_incremental(spark, sf):
    e = all_edges(spark, sf)
    changes = e.filter("checksum % 2 = 0").select("scope_id", F.col("checksum").alias("old"), (F.col("checksum") + 1).alias("new"))
    return writes.shifted(scopes.checksums(e).select("scope_id", "checksum"), changes)


@query("SELECT CAST(c_custkey AS VARCHAR) AS mutation_id, CASE WHEN c_custkey % 3 = 0 THEN 'conflict' ELSE 'rejected_terminal' END AS status, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END AS created FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def rejected_upsert(spark, sf):
    k = F.col("c_custkey")
    t = read(spark, sf, "customer")
    held = t.filter(k % 2 == 0).select(k.cast("string").alias("mutation_id"), F.lit("rejected_terminal").alias("status"), F.lit(1).alias("created"))
    return writes.upsert_rejected(held, t.filter(k % 3 == 0).select(k.cast("string").alias("mutation_id"), F.lit("conflict").alias("status"), F.lit(2).alias("created")))


# --- scalars ----------------------------------------------------------------------------------------------------------------

#: Type names and their portable types, written out from the contract's rules.
KIND_PAIRS = [
    ("text", "string"), ("NUMERIC(10,2)", "float"), ("integer[]", "json"), ("int4range", "string"), ("varchar(20)", "string"), ("bigint", "int64"), ("timestamptz", None), ("bytea", "bytes"),
    ("jsonb", "json"), ("time with time zone", None), ("double precision", "float"), ("uuid", "string"), ("float64", "float"), ("char", None), ("char(3)", None), ("character(3)", "string"),
    ("character varying", "string"), (" Timestamp with time zone ", "datetime"), ("bool", "boolean"), ("int32", "int"), ("date", "date"), ("time", "time"), ("money", None),
]
KINDS = [name for name, _ in KIND_PAIRS]
KIND_ROWS = ", ".join(f"({i}, '{k}', {repr(p) if p else 'NULL'})" for i, (k, p) in enumerate(KIND_PAIRS))


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS record_id, k.name, k.portable FROM part JOIN (VALUES {KIND_ROWS}) k(i, name, portable) ON p_partkey % {len(KINDS)} = k.i")
def portable_type_map(spark, sf):
    name = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_partkey") % len(KINDS) + 1).cast("int"))
    return read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("record_id"), name.alias("name")).withColumn("portable", types.portable_column(F.col("name")))


@query("SELECT CAST(p_partkey AS VARCHAR) AS record_id, p_size > 10 OR (p_size = 10 AND p_partkey % 4 >= 2) AS allowed FROM part WHERE p_partkey % 9 <> 0 UNION ALL SELECT CAST(p_partkey AS VARCHAR), NULL FROM part WHERE p_partkey % 9 = 0")
def semver_gate(spark, sf):
    k = F.col("p_partkey")
    version = F.when(k % 9 == 0, "1.x").otherwise(F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit("."), (k % 4).cast("string"), F.lit(".0-beta")))
    return read(spark, sf, "part").select(k.cast("string").alias("record_id"), (rules.version_parts(version) >= rules.version_parts(F.lit("10.2.0"))).alias("allowed"))


#: Codes with their status and whether a retry helps, written out from the protocol.
ERROR_ROWS = """(0, 'invalid_request', 400, false), (1, 'auth_required', 401, false), (2, 'upgrade_required', 426, false), (3, 'schema_mismatch', 422, false),
    (4, 'table_not_synced', 400, false), (5, 'retry_later', 503, true), (6, 'temporary_unavailable', 503, true), (7, 'sync_error', 500, true)"""


@query(f"SELECT event_id, e.code, e.status, e.retryable FROM events JOIN (VALUES {ERROR_ROWS}) e(i, code, status, retryable) ON event_id % {len(rules.ERRORS)} = e.i")
def error_status_map(spark, sf):
    codes = list(rules.ERRORS)
    code = F.element_at(F.array(*map(F.lit, codes)), (F.col("event_id") % len(codes) + 1).cast("int"))
    table = F.create_map(*[x for c, (s, r) in rules.ERRORS.items() for x in (F.lit(c), F.struct(F.lit(s).alias("status"), F.lit(r).alias("retryable")))])
    return read(spark, sf, "events").select("event_id", code.alias("code")).select("event_id", "code", table[F.col("code")].status.alias("status"), table[F.col("code")].retryable.alias("retryable"))


@query("""SELECT c_custkey AS key, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(instr('0123456789abcdef', substr(h, 17, 1)) - 1 AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid
    FROM (SELECT c_custkey, sha256('customer:' || CAST(c_custkey AS VARCHAR)) AS h FROM customer)""")
def deterministic_ids(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("key"), deterministic_uuid("customer", F.col("c_custkey")).alias("uuid"))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(f"""SELECT table_name, CAST(column_index AS INTEGER) - 1 AS position, column_name, is_nullable AS nullable,
    CASE WHEN data_type LIKE '%[]' THEN 'json' WHEN data_type IN ('TINYINT', 'SMALLINT', 'INTEGER') THEN 'int' WHEN data_type = 'BIGINT' THEN 'int64' WHEN data_type = 'BOOLEAN' THEN 'boolean'
        WHEN data_type IN ('FLOAT', 'DOUBLE') OR data_type LIKE 'DECIMAL%' THEN 'float' WHEN data_type = 'DATE' THEN 'date' WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime' WHEN data_type = 'BLOB' THEN 'bytes' ELSE 'string' END AS portable_type
    FROM duckdb_columns() WHERE table_name IN {TABLES}""")
def manifest_columns(spark, sf):
    rows = serve.manifest({n: read(spark, sf, n) for n in TABLES})
    return spark.createDataFrame([tuple(r.values()) for r in rows], "table_name string, position int, column_name string, portable_type string, nullable boolean")


@query("SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') WHEN o_orderstatus = 'O' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') ELSE CAST(o_orderkey AS VARCHAR) END AS version FROM orders")
def row_versions(spark, sf):
    text = version_text(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    gone, changed = F.when(F.col("o_orderstatus") == "F", text), F.when(F.col("o_orderstatus") == "O", text)
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), row_version(gone, changed, F.col("o_orderkey")).alias("version"))
