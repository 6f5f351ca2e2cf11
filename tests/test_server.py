"""Server composites, the binary decoder, seeds, fixtures and the sync cycle on small tables."""

import struct

import pytest
from pyspark.sql import functions as F

from tests.test_operators import got
from tidescope.functions import rules
from tidescope.operators import buckets, changelog, client, cycle, registry, scopes, seed, server, writes
from tidescope.sources import fixtures, pgoutput
from tidescope.streaming import consume, materialise

LOG = "seq long, scope_id string, table_name string, record_id string, operation int"
CLIENTS = "user_id string, client_id string, scopes array<string>, scope_set_version long, is_active boolean, last_sync long"


def test_nothing_unread_is_compacted(spark):
    log = spark.createDataFrame([(5, "a", "t", "1", 1), (9, "a", "t", "2", 1)], LOG)
    clients = spark.createDataFrame([("u", "c", ["a"], 1, True, None)], CLIENTS)
    points = spark.createDataFrame([], "user_id string, client_id string, scope_id string, checkpoint long")
    assert changelog.safe_seq(clients, points, log).first()[0] == 0
    assert changelog.compact(log, changelog.safe_seq(clients, points, log)).count() == 2
    off = clients.withColumn("is_active", F.lit(False))
    assert changelog.safe_seq(off, points, log).first()[0] == 9 and changelog.compact(log, changelog.safe_seq(off, points, log)).count() == 0
    stale = spark.createDataFrame([("u", "c", ["a"], 1, True, 1000)], CLIENTS)
    after, kept, result = changelog.compaction(stale, points, log, 1000 + 8 * 86_400_000)
    assert [r["is_active"] for r in after.collect()] == [False] and kept.count() == 0
    assert result.first().asDict() == {"deactivated_clients": 1, "safe_seq": 9, "deleted_entries": 2, "batches": 1}


def test_two_events_of_a_record(spark):
    edges = "table_name string, record_id string, scope_id string, checksum long"
    old = spark.createDataFrame([("t", "1", "a", 1), ("t", "2", "a", 2)], edges)
    new = spark.createDataFrame([("t", "1", "b", 3), ("t", "2", "a", 4)], edges)
    events = spark.createDataFrame([("t", "1", 2, 1), ("t", "1", 3, 2), ("t", "2", 3, 3), ("t", "2", 1, 4), ("t", "2", 2, 5)], "table_name string, record_id string, operation int, position int")
    assert got(scopes.diff_entries(events, old, new).select("record_id", "scope_id", "operation", "position")) == [
        ("1", "a", 3, 1), ("1", "b", 1, 1), ("1", "b", 3, 2), ("2", "a", 1, 4), ("2", "a", 2, 5), ("2", "a", 3, 3),
    ]
    assert got(scopes.apply_events(old, events, new)) == [("t", "2", "a", 4)]


def test_outcomes_without_times(spark):
    made = spark.createDataFrame([("m1", "t", "1", "update", 5, None), ("m2", "t", "2", "update", None, None), ("m3", "h", "9", "delete", 5, None), ("m4", "t", "3", "insert", 1, None)], "mutation_id string, table_name string, record_id string, op string, client_time long, base long")
    rows = spark.createDataFrame([("t", "1", None, False), ("t", "2", 100, False), ("t", "3", 5000, True)], "table_name string, record_id string, updated long, deleted boolean")
    tables = spark.createDataFrame([("t", "enabled", True), ("h", "enabled", False)], "table_name string, push_policy string, has_deleted boolean")
    found = {r["mutation_id"]: (r["status"], r["action"] or r["message"]) for r in writes.resolve(made, rows, tables).collect()}
    assert found == {"m1": ("applied", "update"), "m2": ("applied", "update"), "m3": ("applied", "remove"), "m4": ("conflict", "server version is newer")}


def test_a_policy_hook_changes_and_refuses(spark):
    table = spark.createDataFrame([(1, "old", None, None)], "id long, name string, updated_at timestamp, deleted_at timestamp")
    made = spark.createDataFrame([("m1", "1", "update", 5, None, '{"name":"x","id":"7"}'), ("m2", "2", "insert", 5, None, '{"name":"bad"}'), ("m3", "3", "insert", 5, None, '{"name":"none"}')], "mutation_id string, record_id string, op string, client_time long, base long, payload string")

    def hook(batch):
        given = F.when(F.col("payload").contains("none"), None).otherwise(F.regexp_replace("payload", '"x"', '"X", "id": 9'))
        return batch.select("mutation_id", given.alias("payload"), F.when(F.col("payload").contains("bad"), "not here").alias("error"))

    none = spark.createDataFrame([], "table_name string, record_id string, scope_id string, checksum long")
    own = lambda rows: rows.select(F.lit("t").alias("table_name"), F.col("id").cast("string").alias("record_id"), F.lit("s").alias("scope_id"), F.lit(1).cast("long").alias("checksum"))
    done = server.push(made, table, "t", "id", ["name"], none, own, 0, hook=hook)
    assert got(done.table.select("id", "name")) == [(1, "X")]
    assert got(done.results.select("mutation_id", "status", "code", "message")) == [("m1", "applied", None, None), ("m2", "rejected_terminal", "policy_rejected", "not here"), ("m3", "rejected_terminal", "policy_rejected", "rejected by policy")]
    assert got(done.entries.select("seq", "record_id", "operation")) == [(1, "1", 1)]


def text(value):
    raw = value.encode()
    return b"t" + struct.pack(">I", len(raw)) + raw


def row(*cells):
    return struct.pack(">H", len(cells)) + b"".join(cells)


def test_binary_messages_become_changes(spark):
    relation = lambda number, name, columns: b"R" + struct.pack(">I", number) + b"public\0" + name.encode() + b"\0d" + struct.pack(">H", len(columns)) + b"".join(struct.pack(">B", i == 0) + c.encode() + b"\0" + struct.pack(">Ii", 25, -1) for i, c in enumerate(columns))
    head = lambda kind, number: kind + struct.pack(">I", number)
    messages = [
        b"B" + bytes(20), relation(7, "notes", ["id", "body", "deleted_at"]), relation(8, "other", ["id"]),
        head(b"I", 7) + b"N" + row(text("1"), b"n", b"n"), head(b"U", 7) + b"K" + row(text("1"), b"n", b"n") + b"N" + row(text("1"), b"u", text("now")),
        head(b"D", 7) + b"K" + row(text("2"), b"n", b"n"), head(b"I", 8) + b"N" + row(text("3")), head(b"I", 7) + b"N" + row(text(""), b"n", b"n"),
        head(b"I", 7) + b"N" + struct.pack(">H", 3) + b"t" + struct.pack(">I", 99) + b"x", head(b"I", 9) + b"N" + row(text("4")), b"C" + bytes(20),
        relation(7, "notes", ["id", "body", "extra", "deleted_at"]), head(b"U", 7) + b"N" + row(text("5"), text("é"), text("z"), b"n"),
    ]
    table = spark.createDataFrame([(i, bytearray(m)) for i, m in enumerate(messages)], "position long, message binary").repartition(3)
    known = spark.createDataFrame([], "relation long, table_name string, columns array<string>, keys array<string>")
    synced = spark.createDataFrame([("notes", "id", "deleted_at")], "table_name string, pk string, deleted_at string")
    found = {r["position"]: (r["kind"], r["record_id"], r["data"], r["deleted_at"], r["error"]) for r in pgoutput.decode(table, known, synced).collect()}
    assert sorted(found) == [3, 4, 5, 7, 8, 9, 12]
    assert found[3] == ("I", "1", {"id": "1", "body": None, "deleted_at": None}, None, None)
    assert found[4] == ("U", "1", {"id": "1", "deleted_at": "now"}, "now", None)
    assert found[5][:2] == ("D", "2") and found[7][4] == "record without a primary key" and found[8][4].startswith("undecodable") and found[9][4] == "change to an unknown relation"
    assert found[12] == ("U", "5", {"id": "5", "body": "é", "extra": "z", "deleted_at": None}, None, None)


def test_a_stream_keeps_edges_up_to_date(spark, tmp_path):
    kinds = "kind string, table_name string, record_id string, deleted_at string, position int"
    raw, log, bad, edges = (str(tmp_path / n) for n in ("raw", "log", "bad", "edges"))
    spark.createDataFrame([("t", "1", "a", 1), ("t", "2", "a", 2)], "table_name string, record_id string, scope_id string, checksum long").write.parquet(f"{edges}/-1")
    spark.createDataFrame([("U", "t", "1", None, 1), ("D", "t", "2", None, 2), ("I", "elsewhere", "3", None, 3), ("I", "t", "", None, 4)], kinds).coalesce(1).write.parquet(raw)
    desired = lambda events: events.select("table_name", "record_id").distinct().select("*", F.lit("b").alias("scope_id"), F.lit(9).cast("long").alias("checksum"))
    synced = lambda: spark.createDataFrame([("t",)], "table_name string")
    consume(spark.readStream.schema(kinds).parquet(raw), materialise(edges, desired, spark), log, bad, str(tmp_path / "c"), registered=synced).awaitTermination()
    assert got(spark.read.parquet(f"{edges}/0")) == [("t", "1", "b", 9)]
    assert got(spark.read.parquet(log).select("record_id", "scope_id", "operation")) == [("1", "a", 3), ("1", "b", 1), ("2", "a", 3)]
    assert spark.read.parquet(bad).count() == 1


def test_seeds(spark, tmp_path):
    columns = spark.createDataFrame([("t", 0, "id", "int", True), ("t", 1, "ok", "boolean", False), ("t", 2, "name", "string", False)], "table_name string, position int, column_name string, portable_type string, is_key boolean")
    shared = spark.createDataFrame([("global", True), ("news", False)], "scope_id string, portable boolean")
    edges = spark.createDataFrame([("t", "1", "global", 5), ("t", "2", "global", 6), ("t", "3", "news", 7)], "table_name string, record_id string, scope_id string, checksum long")
    rows = spark.createDataFrame([("t", "1", '{"id":1,"ok":true,"name":"x"}', "v", False), ("t", "2", '{"id":2,"ok":false}', "v", True), ("t", "3", "{}", "v", False)], "table_name string, record_id string, row_json string, row_version string, deleted boolean")
    folder = str(tmp_path / "seed")
    seed.export(folder, columns, shared, edges, rows, (3, "h"))
    assert got(spark.read.parquet(f"{folder}/t")) == [(1, 1, "x")]
    assert got(spark.read.parquet(f"{folder}/metadata")) == [(3, "h", 1)] and got(spark.read.parquet(f"{folder}/scopes")) == [("global", 2, 3)]
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        seed.export(folder, columns, shared, edges, rows, (3, "h"))
    seed.export(folder, columns, shared, edges, rows, (4, "i"), overwrite=True)
    assert got(seed.local_tables(columns)) == [("t", "CREATE TABLE `t` (`id` INTEGER PRIMARY KEY, `ok` INTEGER, `name` TEXT)")]
    with pytest.raises(ValueError, match="schema"):
        seed.check(columns, (1, "a"), (2, "a"))
    with pytest.raises(Exception, match="whole number"):
        spark.createDataFrame([("1.5",)], "v string").select(seed.stored(F.col("v"), "int")).collect()


def test_fixtures(spark):
    tree = fixtures.categories(spark)
    assert tree.count() == 5 + 20 + 60 and tree.join(tree.select(F.col("id").alias("p")), F.col("parent_id") == F.col("p")).count() == 80
    docs = fixtures.documents(spark, 2000, 10)
    counts = [r["n"] for r in docs.groupBy("owner").agg(F.count("*").alias("n")).orderBy("owner").collect()]
    assert sum(counts) == 2000 and 0.25 < counts[0] / 2000 < 0.45 and counts[0] > counts[1] > counts[4]
    people = fixtures.members(docs, 10)
    assert people.count() == docs.agg(F.sum("members")).first()[0] == people.select("document_id", "user").distinct().count()
    said = fixtures.comments(docs)
    known = said.select(F.col("id").alias("p"), F.col("document_id").alias("d"))
    assert said.filter("parent_id is not null").join(known, (F.col("parent_id") == F.col("p")) & (F.col("document_id") == F.col("d"))).count() == said.filter("parent_id is not null").count() > 0


def test_older_buckets(spark):
    rows = spark.createDataFrame([("t", "1", "old", 5), ("t", "2", "two", 5)], "table_name string, record_id string, row_json string, version long")
    held = spark.createDataFrame([("a", "t", "1", 1), ("a", "t", "2", 2), ("b", "t", "2", 2)], "bucket_id string, table_name string, record_id string, checksum int")
    changes = spark.createDataFrame([("a", "t", "1", "new", 6, 3), ("a", "t", "3", "three", 1, 4)], "bucket_id string, table_name string, record_id string, row_json string, version long, checksum int")
    deletes = spark.createDataFrame([("a", "t", "2"), ("b", "t", "2")], "bucket_id string, table_name string, record_id string")
    after, members = buckets.apply_page(rows, held, changes, deletes)
    assert got(after) == [("t", "1", "new", 6), ("t", "3", "three", 1)] and got(buckets.checksums(members)) == [("a", 7)]
    lists = spark.createDataFrame([(["a", "b"], ["c", "b"], ["a"])], "k array<string>, x array<string>, y array<string>")
    assert lists.select(buckets.known_buckets(F.col("k"), F.col("x"), F.col("y")), buckets.moved(F.lit(5), F.lit(3))).first()[:] == (["b", "c"], 5)


def test_registry_reports(spark):
    spark.createDataFrame([(2, "u1"), (1, "u2")], "id long, owner string").createOrReplaceTempView("cards")
    known = registry.Registry(spark)
    known.register("cards", "SELECT id AS record_id, concat('user:', owner) AS scope_id FROM cards")
    assert [r["record_id"] for r in known.live_ids("cards").collect()] == ["1", "2"]
    assert known.counters().first()[:] == (1, 2, 2)
    assert got(known.listing().select("table_name", "pk", "push_policy")) == [("cards", "id", "enabled")]
    given = spark.createDataFrame([("cards", "by_owner", ["owner"], False), ("cards", "pk", ["id"], True), ("cards", "other", ["hidden"], False)], "table_name string, index_name string, columns array<string>, is_primary boolean")
    assert [r["index_name"] for r in known.indexes(given).collect()] == ["by_owner"]


def test_small_rules(spark):
    assert rules.error_envelope("retry_later", "wait") == {"error": {"code": "retry_later", "message": "wait", "retryable": True}}
    ids = spark.createDataFrame([("A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11", "007")], "u string, n string")
    assert ids.select(writes.canonical_id(F.col("u"), "uuid"), writes.canonical_id(F.col("n"), "long"), writes.canonical_id(F.col("u"), "long")).first()[:] == ("a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11", "7", None)
    queue = spark.createDataFrame([("m2", 5), ("m1", 3)], "mutation_id string, client_version long")
    assert writes.batch_id(queue).first()[0] == "m1|m2" and writes.batch_id(queue.limit(0)).first()[0] == "empty"
    edits = spark.createDataFrame([("t", "1", "local"), ("t", "2", "server")], "table_name string, record_id string, origin string")
    assert got(client.local_only(edits)) == [("t", "1")]
    tables = spark.createDataFrame([("t", False)], "table_name string, has_deleted boolean")
    page = spark.createDataFrame([("t", "1", "upsert", "{}"), ("zz", "1", "upsert", "{}")], "table_name string, record_id string, op string, row_json string")
    assert client.known_tables(page, tables).count() == 1
    with pytest.raises(Exception, match="tombstone"):
        client.known_tables(page.withColumn("op", F.lit("delete")), tables).collect()
    assert got(client.upserted(page.limit(1), ["id", "name"], "id")) == [("1", None)]


def served(spark, log, edges, rows, clients, results):
    """A server of one client, as the cycle asks it."""

    def pull(held):
        asked = held.select(F.lit("u").alias("user_id"), F.lit("c").alias("client_id"), "scope_id", F.when(F.col("cursor").isNull(), "none").otherwise("ok").alias("cursor"), F.col("cursor").cast("long").alias("checkpoint"))
        found = server.pull(asked, clients, log, edges, rows)
        states, answer = found.states.collect(), found.answers.first()
        changes = found.changes.select("scope_id", "table_name", "record_id", "seq", "op", "row_json", F.col("version").cast("long").alias("version"), "checksum")
        cursors = [(r["scope_id"], str(r["next"])) for r in states if r["next"] is not None]
        sums = [(r["scope_id"], r["checksum"]) for r in states if r["checksum"] is not None]
        return cycle.Page(changes, spark.createDataFrame(cursors, "scope_id string, cursor string"), spark.createDataFrame(sums, "scope_id string, checksum long"), [r["scope_id"] for r in states if r["rebuild"]], answer["has_more"], tuple(answer["add"]), tuple(answer["remove"]))

    return (lambda made: results(made)), pull, (lambda scope, cursor: server.rebuild("u", "c", scope, clients, log, edges, rows, cursor, 2))


def test_a_cycle_and_its_requests(spark):
    log = spark.createDataFrame([(1, "a", "t", "1", 1), (2, "a", "t", "2", 1), (3, "a", "t", "3", 1), (4, "a", "t", "2", 3)], LOG)
    edges = spark.createDataFrame([("t", "1", "a", 11), ("t", "3", "a", 13)], "table_name string, record_id string, scope_id string, checksum long")
    rows = spark.createDataFrame([("t", "1", "one", "1", 11, False), ("t", "3", "three", "3", 13, False)], "table_name string, record_id string, row_json string, row_version string, checksum long, deleted boolean")
    clients = spark.createDataFrame([("u", "c", ["a"], 1, True, None)], CLIENTS)
    applied = lambda made: made.select("mutation_id", "table_name", "record_id", F.lit("applied").alias("status"), F.lit(None).cast("string").alias("code"), F.lit("canon").alias("row_json"), F.lit(50).cast("long").alias("version"))
    ask = served(spark, log, edges, rows, clients, applied)
    empty = lambda kinds: spark.createDataFrame([], kinds)
    copy = cycle.Copy(
        empty("table_name string, record_id string, row_json string, version long"), empty("scope_id string, table_name string, record_id string, checksum long, generation int"),
        spark.createDataFrame([("a", None, None, 0)], "scope_id string, cursor string, checksum long, generation int"), empty("table_name string, record_id string, operation string, base_version long, client_version long"),
    )
    copy, requests = cycle.run(copy, *ask)  # a first start: everything is rebuilt, two rows a page
    assert requests == {"pull": 1, "rebuild": 1} and got(copy.rows) == [("t", "1", "one", 1), ("t", "3", "three", 3)]
    assert got(copy.scopes) == [("a", "4", 11 ^ 13, 1)]
    copy, requests = cycle.run(copy, *ask)  # nothing new
    assert requests == {"pull": 1}
    pending = spark.createDataFrame([("t", "1", "update", 1, 40)], "table_name string, record_id string, operation string, base_version long, client_version long")
    copy, requests = cycle.run(cycle.replace(copy, pending=pending), *ask)
    assert requests == {"push": 1, "pull": 1} and ("t", "1", "canon", 50) in got(copy.rows) and copy.pending.isEmpty()
    held = spark.createDataFrame([("a", "3", 0, 1)], copy.scopes.schema)
    copy, requests = cycle.run(cycle.replace(copy, scopes=held), *ask)  # a delete comes
    assert requests == {"pull": 1} and got(copy.scopes.select("cursor")) == [("4",)]
    with pytest.raises(PermissionError):
        server.rebuild("u", "c", "b", clients, log, edges, rows)


def test_delimited_rows_and_required_columns(spark, tmp_path):
    from pyspark.sql import types as T

    from tidescope.sources import tbl

    (tmp_path / "r.tbl").write_text("1|x y|\n2||\n")
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("name", T.StringType())])
    assert got(tbl(spark, str(tmp_path / "r.tbl"), schema)) == [(1, "x y"), (2, None)]
    strict = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("a", T.StringType(), False), T.StructField("b", T.StringType(), False, {"CURRENT_DEFAULT": "'x'"}), T.StructField("c", T.StringType()), T.StructField("d", T.StringType(), False)])
    assert writes.required_columns(strict, ["id", "a", "b", "c"], ["id"]) == ["a"]
    with pytest.raises(ValueError):
        rules.parse_cursor("v2." + "e30." + "AAAA", "a", "g", b"s")


def test_scope_deltas_and_invalidation(spark):
    held = spark.createDataFrame([("a", "c1", 1, 2), ("b", "c2", 2, 0)], "scope_id string, cursor string, checksum long, generation int")
    rows = spark.createDataFrame([("t", "1", "{}", 1), ("t", "2", "{}", 1)], "table_name string, record_id string, row_json string, version long")
    provenance = spark.createDataFrame([("a", "t", "1", 1, 2), ("b", "t", "2", 2, 0), ("b", "t", "1", 1, 0)], "scope_id string, table_name string, record_id string, checksum long, generation int")
    scopes_, rows_, held_ = client.apply_scope_delta(held, rows, provenance, ["b", "n"], ["a"])
    assert got(scopes_) == [("b", "c2", 2, 0), ("n", None, None, 0)] and rows_.count() == 2 and held_.count() == 2
    _, rows_, _ = client.apply_scope_delta(held, rows, provenance, [], ["b"])
    assert [r["record_id"] for r in rows_.collect()] == ["1"]
    none, nobody = client.invalidate(held, provenance)
    assert got(none) == [("a", None, None, 0), ("b", None, None, 0)] and nobody.isEmpty()
    with pytest.raises(ValueError, match="checksum"):
        client.finish_rebuild(rows, provenance, held, "a", "c9", 99)
