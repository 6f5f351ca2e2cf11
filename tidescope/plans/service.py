"""Queries of the server's composites over the test tables, and their SQL. Many clients are served at once: every customer is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidescope.functions import rules
from tidescope.operators import changelog, scopes, seed, server
from tidescope.plans.registry import EDGES, LOG, SUM, all_edges, clients, query, read
from tidescope.sources import change_log, pgoutput, surrogate

LISTED = """listed AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id, 'c' || CAST(c_custkey AS VARCHAR) AS client_id, ['user:' || CAST(c_custkey AS VARCHAR)] || CASE WHEN c_custkey % 2 = 0 THEN ['global', 'old'] ELSE [] END AS scopes,
    c_custkey % 5 <> 0 AS is_active FROM customer)"""


def listed(spark, sf):
    """Clients with their scopes: their own, and for every second one two more."""
    k = F.col("c_custkey")
    own = F.array(F.concat(F.lit("user:"), k.cast("string")))
    held = F.when(k % 2 == 0, F.concat(own, F.array(F.lit("global"), F.lit("old")))).otherwise(own)
    return read(spark, sf, "customer").select(
        k.cast("string").alias("user_id"), F.concat(F.lit("c"), k.cast("string")).alias("client_id"), held.alias("scopes"),
        F.lit(3).cast("long").alias("scope_set_version"), (k % 5 != 0).alias("is_active"), F.when(k % 7 != 0, k * 1000).alias("last_sync"),
    )


def points(spark, sf):
    k = F.col("user_id").cast("long")
    return listed(spark, sf).select("user_id", "client_id", F.explode("scopes").alias("scope_id"), (k % 40).alias("checkpoint"))


def shared(spark):
    return spark.sql("SELECT * FROM VALUES ('global', true), ('news', false) AS t(scope_id, portable)")


# --- connecting -------------------------------------------------------------------------------------------------------

REQUESTS = """requests AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id, 'c' || CAST(c_custkey + CASE WHEN c_custkey % 11 = 0 THEN 100000000 ELSE 0 END AS VARCHAR) AS client_id, c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0)"""


def requests(spark, sf):
    """Two of three clients connect; some are new, some speak another protocol, some know the schema and some other scopes."""
    k = F.col("c_custkey")
    known = F.when(k % 4 == 0, F.array(F.lit("zz"), F.lit("global"), F.lit("gone"))).otherwise(F.array().cast("array<string>"))
    return read(spark, sf, "customer").filter(k % 3 != 0).select(
        k.cast("string").alias("user_id"), F.concat(F.lit("c"), (k + F.when(k % 11 == 0, 100_000_000).otherwise(0)).cast("string")).alias("client_id"), F.when(k % 13 == 0, 1).otherwise(2).alias("protocol_version"),
        F.when(k % 2 == 0, 7).otherwise(6).alias("schema_version"), F.lit("abc").alias("schema_hash"), known.alias("known_scopes"),
    )


@query(f"""WITH {REQUESTS}, w AS (SELECT *, k % 13 <> 0 AS good FROM requests)
    SELECT user_id, client_id, CASE WHEN NOT good THEN 'upgrade_required' END AS error, CASE WHEN good THEN CASE WHEN k % 11 = 0 THEN 1 ELSE 4 END END AS scope_set_version,
        CASE WHEN good THEN CASE WHEN k % 2 = 0 THEN 'none' ELSE 'replace' END END AS schema_action,
        CASE WHEN good THEN CASE WHEN k % 4 = 0 THEN 'user:' || user_id || ',news' ELSE 'user:' || user_id || ',global,news' END END AS added,
        CASE WHEN good THEN CASE WHEN k % 4 = 0 THEN 'gone,zz' ELSE '' END END AS removed FROM w""")
def connect(spark, sf):
    found = server.connect(requests(spark, sf), listed(spark, sf), points(spark, sf), shared(spark), (7, "abc"))[0]
    return found.select("user_id", "client_id", "error", F.col("scope_set_version").cast("int").alias("scope_set_version"), "schema_action", F.array_join("add", ",").alias("added"), F.array_join("remove", ",").alias("removed"))


@query(f"""WITH {LISTED}, {REQUESTS}, old AS (SELECT user_id, client_id, unnest(scopes) AS scope_id, CAST(user_id AS BIGINT) % 40 AS checkpoint FROM listed),
    new AS (SELECT user_id, client_id, unnest(['user:' || user_id, 'global', 'news']) AS scope_id FROM requests WHERE k % 13 <> 0)
    SELECT * FROM old UNION ALL SELECT user_id, client_id, scope_id, 0 FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.user_id = new.user_id AND old.client_id = new.client_id AND old.scope_id = new.scope_id)""")
def connect_checkpoints(spark, sf):
    return server.connect(requests(spark, sf), listed(spark, sf), points(spark, sf), shared(spark), (7, "abc"))[2]


# --- pulling ------------------------------------------------------------------------------------------------------------

#: Readers of the change log: 20 clients, each with the scopes of a user and of the one before and the one after.
READERS = """readers AS (SELECT CAST(r AS VARCHAR) AS user_id, 'c' AS client_id, ['user:' || CAST(r % 15 AS VARCHAR), 'user:' || CAST((r + 1) % 15 AS VARCHAR), 'user:' || CAST((r + 14) % 15 AS VARCHAR)] AS scopes FROM range(20) t(r)),
    asked AS (SELECT user_id, client_id, s.scope_id, CASE WHEN (r + s.place) % 6 = 0 THEN 'stale' WHEN (r + s.place) % 6 = 1 THEN 'none' ELSE 'ok' END AS cursor, CASE WHEN (r + s.place) % 6 > 1 THEN (r * 7 + s.place) % 60 END AS checkpoint
        FROM (SELECT *, CAST(user_id AS BIGINT) AS r, unnest([{'scope_id': scopes[1], 'place': 0}, {'scope_id': scopes[2], 'place': 1}, {'scope_id': 'user:x', 'place': 2}]) AS s FROM readers))"""


def readers(spark):
    r = F.col("id")
    scope = lambda d: F.concat(F.lit("user:"), ((r + d) % 15).cast("string"))
    return spark.range(20).select(r.cast("string").alias("user_id"), F.lit("c").alias("client_id"), F.array(scope(0), scope(1), scope(14)).alias("scopes"), F.lit(5).cast("long").alias("scope_set_version"), F.lit(True).alias("is_active"), F.lit(None).cast("long").alias("last_sync"))


def asked(spark):
    r, place = F.col("user_id").cast("long"), F.col("place")
    rows = readers(spark).select("user_id", "client_id", F.posexplode(F.array(F.col("scopes")[0], F.col("scopes")[1], F.lit("user:x"))).alias("place", "scope_id"))
    turn = (r + place) % 6
    return rows.select("user_id", "client_id", "scope_id", F.when(turn == 0, "stale").when(turn == 1, "none").otherwise("ok").alias("cursor"), F.when(turn > 1, (r * 7 + place) % 60).alias("checkpoint"))


PULLED = f"""WITH {LOG}, {READERS}, late AS (SELECT * FROM log WHERE seq > 20), mine AS (SELECT a.* FROM asked a JOIN readers r USING (user_id, client_id) WHERE list_contains(r.scopes, a.scope_id)),
    judged AS (SELECT *, cursor = 'stale' OR cursor = 'none' OR coalesce(checkpoint > 0 AND checkpoint < (SELECT min(seq) FROM late), false) AS rebuild FROM mine),
    probe AS (SELECT j.user_id, j.client_id, late.*, row_number() OVER (PARTITION BY user_id, client_id ORDER BY seq, scope_id) AS place FROM late JOIN judged j USING (scope_id) WHERE NOT rebuild AND seq > coalesce(checkpoint, 0)),
    more AS (SELECT user_id, client_id, max(place) > 50 AS has_more FROM probe GROUP BY ALL), page AS (SELECT * FROM probe WHERE place <= 50)"""


def pulled(spark, sf):
    k = F.col("p_partkey")
    rows = read(spark, sf, "part").select(F.lit("items").alias("table_name"), k.cast("string").alias("record_id"), F.col("p_name").alias("row_json"), F.col("p_size").cast("string").alias("row_version"), surrogate(k.cast("long")).alias("checksum"))
    edges = change_log(spark, sf).select("table_name", "record_id", "scope_id", (F.col("seq") * 3).alias("checksum"))
    return server.pull(asked(spark), readers(spark), change_log(spark, sf).filter("seq > 20"), edges, rows, 50)


@query(PULLED + f""", k AS (SELECT user_id, client_id, table_name, record_id, max(seq) AS seq FROM page GROUP BY ALL), e AS (SELECT page.* FROM k JOIN page USING (user_id, client_id, table_name, record_id, seq))
    SELECT user_id, client_id, scope_id, table_name, record_id, '{{"id":"' || record_id || '"}}' AS pk, CASE WHEN operation = 3 THEN 'delete' ELSE 'upsert' END AS op, seq, p_name AS row_json,
        coalesce(CAST(p_size AS VARCHAR), CAST(seq AS VARCHAR)) AS version, {SUM.format('p_partkey')} AS checksum FROM e LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = record_id WHERE operation = 3 OR p_name IS NOT NULL""")
def pull(spark, sf):
    return pulled(spark, sf).changes


@query(PULLED + """, ended AS (SELECT user_id, client_id, scope_id, max(seq) AS moved FROM page GROUP BY ALL), sums AS (SELECT scope_id, bit_xor(seq * 3) AS total FROM log GROUP BY ALL)
    SELECT j.user_id, j.client_id, j.scope_id, j.rebuild, CASE WHEN NOT j.rebuild THEN coalesce(moved, checkpoint) END AS next, CASE WHEN NOT j.rebuild AND NOT coalesce(has_more, false) THEN coalesce(total, 0) END AS checksum
    FROM judged j LEFT JOIN more USING (user_id, client_id) LEFT JOIN ended USING (user_id, client_id, scope_id) LEFT JOIN sums USING (scope_id)""")
def pull_states(spark, sf):
    return pulled(spark, sf).states


@query(PULLED + """ SELECT r.user_id, r.client_id, coalesce(has_more, false) AS has_more, 5 AS scope_set_version, scopes[3] AS added, 'user:x' AS removed FROM readers r LEFT JOIN more USING (user_id, client_id)""")
def pull_answers(spark, sf):
    return pulled(spark, sf).answers.select("user_id", "client_id", "has_more", F.col("scope_set_version").cast("int").alias("scope_set_version"), F.array_join("add", ",").alias("added"), F.array_join("remove", ",").alias("removed"))


# --- rebuilding -----------------------------------------------------------------------------------------------------------

WANTED = "wanted AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id, 'c' || CAST(c_custkey AS VARCHAR) AS client_id, CASE WHEN c_custkey % 2 = 0 THEN 'user:' || CAST(c_custkey AS VARCHAR) ELSE 'global' END AS scope_id FROM customer)"


def wanted(spark, sf):
    """Even customers ask for their own scope, odd ones for one that they don't subscribe to."""
    k = F.col("c_custkey")
    return read(spark, sf, "customer").select(k.cast("string").alias("user_id"), F.concat(F.lit("c"), k.cast("string")).alias("client_id"), F.when(k % 2 == 0, F.concat(F.lit("user:"), k.cast("string"))).otherwise("global").alias("scope_id"))


def order_rows(spark, sf):
    k = F.col("o_orderkey")
    return read(spark, sf, "orders").select(F.lit("orders").alias("table_name"), k.cast("string").alias("record_id"), F.col("o_orderpriority").alias("row_json"), F.col("o_orderstatus").alias("row_version"), surrogate(k).alias("checksum"), (F.col("o_orderstatus") == "F").alias("deleted"))


@query(f"""WITH {EDGES}, {WANTED} SELECT user_id, client_id, scope_id, table_name, record_id, o_orderpriority AS row_json, o_orderstatus AS row_version, {SUM.format('o_orderkey')} AS row_checksum
    FROM wanted JOIN edges USING (scope_id) JOIN orders ON table_name = 'orders' AND record_id = CAST(o_orderkey AS VARCHAR) WHERE scope_id LIKE 'user:%' AND o_orderstatus <> 'F'""")
def rebuild_records(spark, sf):
    return server.rebuild_all(wanted(spark, sf), listed(spark, sf), change_log(spark, sf), all_edges(spark, sf), order_rows(spark, sf))[0]


@query(f"""WITH {EDGES}, {WANTED}, {LISTED}, {LOG}, old AS (SELECT user_id, client_id, unnest(scopes) AS scope_id, CAST(user_id AS BIGINT) % 40 AS checkpoint FROM listed)
    SELECT user_id, client_id, scope_id, CASE WHEN CAST(user_id AS BIGINT) % 2 = 0 THEN greatest(checkpoint, (SELECT max(seq) FROM log)) ELSE checkpoint END AS checkpoint FROM old""")
def rebuild_complete(spark, sf):
    """Checkpoints once the rebuilds are done: the client's lower ones rise too."""
    done = server.rebuild_all(wanted(spark, sf), listed(spark, sf), change_log(spark, sf), all_edges(spark, sf), order_rows(spark, sf))[1]
    return server.complete_rebuild(listed(spark, sf), points(spark, sf), done, 5_000_000)[1]


# --- pushing to the customers ---------------------------------------------------------------------------------------------

#: Customers with an update time, a deletion time for every tenth, and a mutation for every customer and some that are new.
PUSHED = """base AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment, TIMESTAMP '2024-01-01 00:00:00' AS updated_at, CASE WHEN c_custkey % 10 = 0 THEN TIMESTAMP '2024-01-02 00:00:00' END AS deleted_at FROM customer),
    m AS (SELECT c_custkey + CASE WHEN c_custkey % 7 = 4 THEN 100000000 ELSE 0 END AS id, c_custkey AS k, CASE c_custkey % 7 WHEN 1 THEN 'update' WHEN 2 THEN 'delete' WHEN 3 THEN 'insert' WHEN 4 THEN 'insert' WHEN 5 THEN 'upsert' ELSE 'update' END AS op FROM customer WHERE c_custkey % 7 <> 0),
    j AS (SELECT m.*, b.c_custkey IS NOT NULL AS here, b.deleted_at IS NOT NULL AS gone, k % 7 = 6 AS late FROM m LEFT JOIN base b ON b.c_custkey = m.id),
    o AS (SELECT *, CASE WHEN op = 'insert' AND NOT here THEN 'insert' WHEN op = 'insert' AND gone THEN 'resurrect' WHEN op IN ('update', 'upsert') AND NOT gone AND NOT late THEN 'update' WHEN op = 'delete' AND NOT gone THEN 'delete' WHEN op = 'delete' THEN 'keep' END AS action FROM j)"""


def pushed(spark, sf):
    k = F.col("c_custkey")
    table = read(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_acctbal", "c_mktsegment", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("updated_at"), F.when(k % 10 == 0, F.lit("2024-01-02 00:00:00").cast("timestamp")).alias("deleted_at")
    )
    op = F.element_at(F.array(*map(F.lit, ("update", "delete", "insert", "insert", "upsert", "update"))), (k % 7).cast("int"))
    new = F.concat(F.lit("new "), k.cast("string"))
    payload = F.when(k % 7 == 5, F.to_json(F.struct(new.alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment")), {"ignoreNullFields": "false"})).otherwise(F.to_json(F.struct(new.alias("c_name"), F.lit(1.5).alias("c_acctbal"), F.lit("9").alias("c_custkey"))))
    march = 1_709_251_200_000  # 2024-03-01
    made = read(spark, sf, "customer").filter(k % 7 != 0).select(
        k.cast("string").alias("mutation_id"), (k + F.when(k % 7 == 4, 100_000_000).otherwise(0)).cast("string").alias("record_id"), op.alias("op"),
        F.when(k % 7 == 6, F.lit(0)).otherwise(F.lit(march)).cast("long").alias("client_time"), F.lit(None).cast("long").alias("base"), payload.alias("payload"),
    )
    own = lambda rows: scopes.edges("customer", scopes.owned(rows.filter("deleted_at is null"), F.col("c_custkey"), F.concat(F.lit("user:"), (F.col("c_custkey") % 16).cast("string"))), rows.select(F.col("c_custkey").cast("string").alias("record_id"), surrogate(F.col("c_custkey")).alias("checksum")))
    return server.push(made, table, "customer", "c_custkey", ["c_name", "c_acctbal", "c_mktsegment"], own(table), own, 500, required=["c_name"], now=F.lit("2024-06-01 00:00:00").cast("timestamp"))


@query(f"""WITH {PUSHED}, w AS (SELECT * FROM o WHERE action IN ('insert', 'update', 'resurrect', 'delete'))
    SELECT coalesce(c_custkey, id) AS c_custkey, CASE WHEN action IN ('insert', 'update', 'resurrect') THEN 'new ' || CAST(k AS VARCHAR) ELSE c_name END AS c_name,
        CASE WHEN action IN ('insert', 'update', 'resurrect') AND k % 7 <> 5 THEN 1.5 ELSE c_acctbal END AS c_acctbal, CASE WHEN action = 'update' AND k % 7 = 5 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
        CASE WHEN action IN ('insert', 'update', 'resurrect') THEN TIMESTAMP '2024-03-01 00:00:00' ELSE updated_at END AS updated_at,
        CASE WHEN action = 'delete' THEN TIMESTAMP '2024-06-01 00:00:00' WHEN action = 'resurrect' THEN NULL ELSE deleted_at END AS deleted_at FROM base FULL JOIN w ON c_custkey = id""")
def push_apply(spark, sf):
    return pushed(spark, sf).table


@query(f"""WITH {PUSHED} SELECT CAST(k AS VARCHAR) AS mutation_id, 'customer' AS table_name, CAST(id AS VARCHAR) AS record_id, CASE WHEN op = 'upsert' THEN 'update' ELSE op END AS op,
        CASE WHEN action IS NOT NULL THEN 'applied' WHEN op = 'insert' OR gone OR late THEN 'conflict' END AS status, CASE WHEN action IS NULL THEN 'version_conflict' END AS code,
        CASE WHEN action IS NOT NULL THEN NULL WHEN op = 'insert' THEN 'record already exists' WHEN gone THEN 'record has been deleted' ELSE 'server version is newer' END AS message,
        CASE WHEN action IN ('insert', 'update', 'resurrect') THEN 1709251200000 WHEN action = 'delete' THEN 1717200000000 ELSE 1704067200000 END AS version FROM o""")
def push_results(spark, sf):
    return pushed(spark, sf).results


@query(f"""WITH {PUSHED}, e AS (SELECT CAST(id AS VARCHAR) AS record_id, 'user:' || CAST(id % 16 AS VARCHAR) AS scope_id, CASE action WHEN 'delete' THEN 3 WHEN 'update' THEN 2 ELSE 1 END AS operation
        FROM o WHERE action IN ('insert', 'update', 'resurrect', 'delete'))
    SELECT row_number() OVER (ORDER BY record_id, scope_id) + 500 AS seq, 'customer' AS table_name, record_id, scope_id, operation FROM e""")
def push_entries(spark, sf):
    """Change-log entries of the push: a resurrected row is added to its scope anew."""
    return pushed(spark, sf).entries


@query(f"""WITH {PUSHED} SELECT 'customer' AS table_name, CAST(coalesce(c_custkey, id) AS VARCHAR) AS record_id, 'user:' || CAST(coalesce(c_custkey, id) % 16 AS VARCHAR) AS scope_id, {SUM.format('coalesce(c_custkey, id)')} AS checksum
    FROM base FULL JOIN (SELECT * FROM o WHERE action IS NOT NULL) ON c_custkey = id WHERE CASE WHEN action IN ('insert', 'resurrect') THEN true WHEN action = 'delete' THEN false ELSE deleted_at IS NULL END""")
def push_edges(spark, sf):
    return pushed(spark, sf).edges


# --- shared scopes ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {LISTED} SELECT user_id, array_to_string(CASE WHEN is_active THEN scopes || ['news'] ELSE scopes END, ',') AS scopes, CASE WHEN is_active THEN 4 ELSE 3 END AS scope_set_version FROM listed""")
def shared_scope_append(spark, sf):
    after = server.share(listed(spark, sf), points(spark, sf), shared(spark), "news", True)[0]
    return after.select("user_id", F.array_join("scopes", ",").alias("scopes"), F.col("scope_set_version").cast("int").alias("scope_set_version"))


@query(f"""WITH {LISTED} SELECT user_id, array_to_string(CASE WHEN is_active THEN list_filter(scopes, lambda s: s <> 'global') ELSE scopes END, ',') AS scopes, CASE WHEN is_active AND list_contains(scopes, 'global') THEN 4 ELSE 3 END AS scope_set_version FROM listed""")
def shared_scope_remove(spark, sf):
    after = server.unshare(listed(spark, sf), points(spark, sf), shared(spark), "global")[0]
    return after.select("user_id", F.array_join("scopes", ",").alias("scopes"), F.col("scope_set_version").cast("int").alias("scope_set_version"))


@query(f"""WITH {LISTED}, old AS (SELECT user_id, client_id, unnest(scopes) AS scope_id, CAST(user_id AS BIGINT) % 40 AS checkpoint FROM listed)
    SELECT * FROM old WHERE scope_id <> 'global' UNION ALL SELECT user_id, client_id, 'news', 0 FROM listed WHERE is_active""")
def shared_scope_checkpoints(spark, sf):
    """One scope is shared, another no longer."""
    after, held, names = server.share(listed(spark, sf), points(spark, sf), shared(spark), "news", False)
    return server.unshare(after, held, names, "global")[1]


# --- compaction, reports, seeds -----------------------------------------------------------------------------------------------


@query(f"""WITH {LOG}, c AS (SELECT c_custkey AS k, c_custkey % 5 <> 0 AS is_active, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey * 1000 END AS last_sync FROM customer),
    g AS (SELECT *, is_active AND coalesce(last_sync < 1000000 - 900000, false) AS stale FROM c), s AS (SELECT min(100 + k % 400) AS safe_seq FROM g WHERE is_active AND NOT stale),
    d AS (SELECT count(*) AS deleted_entries FROM log, s WHERE seq <= safe_seq) SELECT (SELECT count(*) FROM g WHERE stale) AS deactivated_clients, safe_seq, deleted_entries, CAST(floor(deleted_entries / 40.0) AS BIGINT) + 1 AS batches FROM s, d""")
def compact_result(spark, sf):
    k = F.col("c_custkey")
    held = read(spark, sf, "customer").select(k.cast("string").alias("user_id"), F.concat(F.lit("c"), k.cast("string")).alias("client_id"), (k % 400 + 100).alias("checkpoint"))
    return changelog.compaction(clients(spark, sf), held, change_log(spark, sf), 1_000_000, 900_000, 40)[2]


@query(f"""WITH {LOG} SELECT 0 AS safe_seq, count(*) AS retained FROM log""")
def compact_unread(spark, sf):
    """Active clients that have no checkpoint yet: nothing goes."""
    none = points(spark, sf).filter(F.lit(False))
    safe = changelog.safe_seq(clients(spark, sf), none, change_log(spark, sf))
    return changelog.compact(change_log(spark, sf), safe).agg(F.count("*").alias("retained")).crossJoin(safe).select(F.col("safe_seq").cast("int").alias("safe_seq"), "retained")


@query(f"""WITH {EDGES}, {LISTED}, s AS (SELECT scope_id, count(*) AS members, bit_xor(checksum) AS checksum FROM edges GROUP BY 1), l AS (SELECT *, unnest(scopes) AS scope_id FROM listed)
    SELECT user_id, client_id, is_active, 3 AS scope_set_version, scope_id, CAST(user_id AS BIGINT) % 40 AS checkpoint, coalesce(members, 0) AS members, checksum FROM l LEFT JOIN s USING (scope_id)""")
def debug_report(spark, sf):
    return server.debug(listed(spark, sf), points(spark, sf), all_edges(spark, sf)).withColumn("scope_set_version", F.col("scope_set_version").cast("int"))


@query(f"""WITH {EDGES} SELECT scope_id, count(*) AS members, bit_xor(checksum) AS checksum FROM edges WHERE scope_id = 'global' GROUP BY 1 UNION ALL SELECT 'news', 0, 0 WHERE false""")
def seed_manifest(spark, sf):
    """Portable scopes with members and checksum."""
    return seed.manifest(shared(spark), all_edges(spark, sf))


@query(f"""WITH {EDGES} SELECT scope_id, table_name, record_id, o_orderpriority AS row_json FROM edges JOIN orders ON table_name = 'orders' AND record_id = CAST(o_orderkey AS VARCHAR) WHERE scope_id = 'user:3' AND o_orderstatus <> 'F'""")
def seed_rows(spark, sf):
    portable = spark.sql("SELECT 'user:3' AS scope_id, true AS portable")
    return seed.rows(portable, all_edges(spark, sf), order_rows(spark, sf)).select("scope_id", "table_name", "record_id", "row_json")


# --- lists of scopes -------------------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT c_custkey, ['a', '', 'b', 'a', 'c' || CAST(c_custkey % 3 AS VARCHAR)] AS found FROM customer)
    SELECT c_custkey AS key, 'a,b,c' || CAST(c_custkey % 3 AS VARCHAR) AS scopes, CASE WHEN c_custkey % 3 = 1 THEN 'a,b' ELSE 'a,b,c' || CAST(c_custkey % 3 AS VARCHAR) END AS added,
        CASE WHEN c_custkey % 3 = 1 THEN 'c1' ELSE '' END AS kept, CASE WHEN c_custkey % 3 = 1 THEN 'z' ELSE 'c1,z' END AS removed FROM l""")
def scope_lists(spark, sf):
    """Scope arrays in order of first appearance, and their difference to what a record had."""
    k = F.col("c_custkey")
    found = scopes.scope_list(F.array(F.lit("a"), F.lit(""), F.lit("b"), F.lit("a"), F.concat(F.lit("c"), (k % 3).cast("string"))))
    added, kept, removed = scopes.list_difference(F.array(F.lit("c1"), F.lit("z")), found)
    return read(spark, sf, "customer").select(k.alias("key"), *[F.array_join(c, ",").alias(n) for c, n in ((found, "scopes"), (added, "added"), (kept, "kept"), (removed, "removed"))])


@query("""SELECT CAST(a.conv_id AS VARCHAR) || ':' || CAST(a.turn AS VARCHAR) AS record_id, 'user:' || b.role AS scope_id FROM conversations a JOIN (SELECT DISTINCT conv_id, role FROM conversations) b USING (conv_id)
    WHERE a.turn IS NOT NULL AND b.role IS NOT NULL GROUP BY ALL""")
def scope_resolve_fellows(spark, sf):
    """Each turn of a conversation belongs to all who speak in it."""
    turns = read(spark, sf, "conversations").filter("turn is not null and role is not null").withColumn("record", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return scopes.fellows(turns, "conv_id", "record", "role")


@query("""SELECT event_id AS key, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 'x' END AS plain, event_id % 3 <> 0 AS has FROM events""")
def absent_is_not_null(spark, sf):
    """A map of a row's values: a key that is absent was not sent, a null one is null."""
    e = F.col("event_id")
    values = F.when(e % 3 == 0, F.create_map(F.lit("b"), F.lit("y"))).when(e % 3 == 1, F.create_map(F.lit("a"), F.lit("x"))).otherwise(F.create_map(F.lit("a"), F.lit(None).cast("string")))
    return read(spark, sf, "events").select(e.alias("key"), values["a"].alias("plain"), F.map_contains_key(values, "a").alias("has"))




@query("""SELECT event_id AS position, 'items' AS table_name, CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS kind, CAST(event_id AS VARCHAR) AS record_id,
    CASE WHEN event_type NOT IN ('signup', 'error') AND event_id % 10 = 0 THEN 'x' END AS deleted_at, CASE WHEN event_type <> 'error' AND event_id % 4 <> 1 THEN event_type END AS note, event_type = 'error' OR event_id % 4 <> 1 AS sent
    FROM events WHERE event_id % 9 <> 0""")
def wal_binary_decode(spark, sf):
    """Events as binary replication messages and back; a ninth belongs to a table that isn't synced, and of a quarter an unchanged value isn't sent."""
    e = F.col("event_id")
    number = lambda n, width: F.unhex(F.lpad(F.hex(n), width, "0"))
    cell = lambda v: F.concat(F.encode(F.lit("t"), "utf-8"), number(F.octet_length(v), 8), F.encode(v, "utf-8"))
    mark = lambda c: F.encode(F.lit(c), "utf-8")
    kind = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    gone = F.when((kind == "U") & (e % 10 == 0), cell(F.lit("x"))).otherwise(mark("n"))
    note = F.when(kind == "D", mark("n")).when(e % 4 == 1, mark("u")).otherwise(cell(F.col("event_type")))
    body = F.concat(number(F.lit(3), 4), cell(e.cast("string")), note, gone)
    message = F.concat(F.encode(kind, "utf-8"), number(F.when(e % 9 == 0, 8).otherwise(7), 8), F.when(kind == "D", mark("K")).otherwise(mark("N")), body)
    columns = F.array(*map(F.lit, ("id", "note", "deleted_at")))
    known = spark.createDataFrame([(7, "items"), (8, "others")], "relation long, table_name string").select("*", columns.alias("columns"), F.array(F.lit("id")).alias("keys"))
    synced = spark.sql("SELECT 'items' AS table_name, 'id' AS pk, 'deleted_at' AS deleted_at")
    found = pgoutput.decode(read(spark, sf, "events").select(e.alias("position"), message.alias("message")), known, synced)
    return found.select("position", "table_name", "kind", "record_id", "deleted_at", F.col("data")["note"].alias("note"), F.map_contains_key("data", "note").alias("sent"))


@query("""SELECT event_id AS key, CASE WHEN event_id % 3 = 0 THEN 'server' WHEN event_id % 3 = 1 THEN 'client' ELSE 'server' END AS winner FROM events""")
def server_wins_rule(spark, sf):
    """Two tables under the last-write rule and one where the server always wins."""
    e = F.col("event_id")
    last = rules.last_write(F.lit(1000), F.when(e % 3 == 1, 1200).otherwise(2000), F.lit(None).cast("long"))[0]
    return read(spark, sf, "events").select(e.alias("key"), F.when(e % 3 == 0, rules.server_wins()[0]).otherwise(last).alias("winner"))
