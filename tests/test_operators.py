"""Small cases of operators, rules and the change stream."""

import itertools

import pytest

from tidescope.functions import rules, types
from tidescope.functions.canonical import row_json, signed_crc32
from tidescope.operators import client, contract, registry, scopes, serve, writes
from tidescope.streaming import consume

ROWS = "table_name string, record_id string, row_json string, version long"
HELD = "scope_id string, table_name string, record_id string, checksum int, generation int"
SCOPES = "scope_id string, cursor string, checksum int, generation int"
PAGE = "scope_id string, table_name string, record_id string, seq long, op string, row_json string, version long, checksum int"


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_checksums_of_known_rows(spark):
    """CRC-32 of canonical rows."""
    row = spark.createDataFrame([("test", "abc")], "name string, id string").select(row_json(["name", "id"]).alias("j"))
    assert row.select("j", signed_crc32(row.j)).first()[:] == ('{"id":"abc","name":"test"}', 1221324213)
    row = spark.createDataFrame([(1, 2, 3)], "b int, c int, a int").selectExpr("b as a", "c as b", "a as c")
    assert row.select(signed_crc32(row_json(["c", "b", "a"]))).first()[0] == 785669035


def test_cursors_are_signed_and_bound():
    token = rules.issue_cursor("user:1", "g1", 42, b"s")
    assert rules.parse_cursor(token, "user:1", "g1", b"s") == ("ok", 42)
    assert rules.parse_cursor(None, "user:1", "g1", b"s") == ("none", None)
    assert rules.parse_cursor("v1.x", "user:1", "g1", b"s") == ("stale", None)
    assert rules.parse_cursor(token, "user:1", "g2", b"s") == ("stale", None)
    assert rules.parse_cursor(token, "user:1", "g1", b"other") == ("stale", None)
    for bad, scope in (("v2.x", "user:1"), (token, "user:2")):
        with pytest.raises(ValueError):
            rules.parse_cursor(bad, scope, "g1", b"s")


def test_limits_and_types():
    assert [rules.clamp(n) for n in (-1, 0, 7, 1000, 5000)] == [100, 100, 7, 1000, 1000]
    assert [types.portable(n) for n in ("TEXT", "numeric(5,2)", "int[]", "tstzrange", "nope")] == ["string", "float", "json", "string", None]
    assert serve.parse_page_cursor("a|b|c") == ("a", "b|c") and serve.parse_page_cursor("ab") is None


def test_edge_differences(spark):
    kinds = "table_name string, record_id string, scope_id string"
    old = spark.createDataFrame([("t", "1", "a"), ("t", "1", "b"), ("t", "2", "a")], kinds)
    new = spark.createDataFrame([("t", "1", "b"), ("t", "1", "c"), ("t", "3", "a")], kinds)
    events = spark.createDataFrame([("t", "1", 1), ("t", "2", 3), ("t", "3", 3)], "table_name string, record_id string, operation int")
    assert got(scopes.diff_entries(events, old, new).select("record_id", "scope_id", "operation")) == [("1", "a", 3), ("1", "b", 2), ("1", "c", 1), ("2", "a", 3), ("3", "a", 3)]


def test_fold_of_local_edits(spark):
    """The queue after every short history of edits, against the table of transitions."""
    want, rows = {}, []
    for n, history in enumerate(itertools.chain(*(itertools.product(("insert", "update", "delete"), repeat=k) for k in (1, 2, 3)))):
        op = None
        try:
            for kind in history:
                op = writes.FOLD[op, kind]
        except KeyError:
            continue
        want[str(n)] = op
        rows += [("t", str(n), i, kind, 10 + i, 100 + i) for i, kind in enumerate(history)]
    found = writes.fold_local(spark.createDataFrame(rows, "table_name string, record_id string, position int, kind string, old_version long, at long"))
    assert {r["record_id"]: r["operation"] for r in found.collect()} == {k: v for k, v in want.items() if v}


def test_rounds_and_batches(spark):
    made = spark.createDataFrame([("t", "1", 5), ("t", "1", 3), ("t", "2", 4)], "table_name string, record_id string, position int")
    assert got(writes.in_rounds(made).select("position", "round")) == [(3, 1), (4, 1), (5, 2)]
    assert [len(b) for b in writes.batches(range(250))] == [100, 100, 50]


def test_a_page_on_a_client(spark):
    rows = spark.createDataFrame([("t", "1", "old", 5), ("t", "2", "old", 5), ("t", "3", "old", 5), ("t", "4", "old", 9)], ROWS)
    held = spark.createDataFrame([("a", "t", "1", 1, 0), ("a", "t", "2", 2, 0), ("b", "t", "2", 2, 0), ("a", "t", "3", 3, 0), ("a", "t", "4", 4, 0)], HELD)
    known = spark.createDataFrame([("a", "c1", 1, 3), ("b", "c1", 1, 0)], SCOPES)
    page = spark.createDataFrame([
        ("a", "t", "1", 1, "upsert", "mid", 6, 10), ("a", "t", "1", 2, "upsert", "new", 7, 11), ("a", "t", "2", 3, "delete", None, 6, None),
        ("a", "t", "3", 4, "delete", None, 6, None), ("a", "t", "4", 5, "upsert", "stale", 8, 12), ("a", "t", "5", 6, "upsert", "new", 1, 13),
    ], PAGE)
    after, provenance = client.apply_changes(rows, held, known, page)
    assert got(after) == [("t", "1", "new", 7), ("t", "2", "old", 5), ("t", "4", "old", 9), ("t", "5", "new", 1)]
    assert got(provenance) == [("a", "t", "1", 11, 3), ("a", "t", "4", 12, 3), ("a", "t", "5", 13, 3), ("b", "t", "2", 2, 0)]
    cursors = spark.createDataFrame([("a", "c2")], "scope_id string, cursor string")
    server = spark.createDataFrame([("a", 11 ^ 12 ^ 13), ("b", 3)], "scope_id string, checksum int")
    ended = client.end_page(known, cursors, server, provenance)
    assert got(ended) == [("a", "c2", 11 ^ 12 ^ 13, 3), ("b", None, None, 0)]
    asked = spark.createDataFrame([("x",)], "scope_id string")
    assert got(client.to_rebuild(ended, asked)) == [("b",)]
    assert got(client.begin_rebuild(known, ["a"])) == [("a", None, None, 4), ("b", "c1", 1, 0)]
    left, provenance = client.remove_scope(after, provenance, "a")
    assert got(left) == [("t", "2", "old", 5)] and got(provenance) == [("b", "t", "2", 2, 0)]


def test_pushing_and_settling(spark):
    pending = spark.createDataFrame([("t", "1", "create", None, 5), ("t", "2", "delete", 3, 6), ("t", "3", "update", 3, 7)], "table_name string, record_id string, operation string, base_version long, client_version long")
    rows = spark.createDataFrame([("t", "1", "{}", 5), ("t", "2", "{}", 6)], ROWS)
    assert got(client.mutations(pending, rows).select("mutation_id", "op", "row_json")) == [("t:1:create:5", "insert", "{}"), ("t:2:delete:6", "delete", None)]
    results = spark.createDataFrame([("m1", "t", "1", "applied", "inserted"), ("m2", "t", "2", "rejected_retryable", "busy"), ("m3", "t", "3", "conflict", "version_conflict")], "mutation_id string, table_name string, record_id string, status string, code string")
    left, rejected = client.settle(pending, results)
    assert [r[1] for r in got(left)] == ["2"] and got(rejected) == [("m3", "t", "3", "conflict", "version_conflict")]


def test_contract_checks(spark):
    pages = spark.createDataFrame([(True, "c", None), (True, None, "s"), (True, None, None), (False, None, "s"), (False, "c", None), (False, "c", "s")], "has_more boolean, final_cursor string, checksum string")
    kinds = [r["violation"] for r in contract.rebuild_pages(pages).coalesce(1).collect()]
    assert kinds == ["early_final_cursor", "early_checksum", None, "no_final_cursor", "no_final_checksum", None]
    pulls = spark.createDataFrame([(True, None), (False, None), (False, "x")], "has_more boolean, checksums string")
    assert [r["violation"] for r in contract.pull_pages(pulls).coalesce(1).collect()] == [None, "no_final_checksums", None]
    columns = spark.createDataFrame([("t", "a", "int"), ("t", "a", "int"), ("t", "b", "money"), ("t", "", "int"), ("", "c", "int"), ("t", "ok", "json")], "table_name string, column_name string, portable_type string")
    uses = spark.createDataFrame([("t", "ok", "key"), ("t", "zz", "index_column")], "table_name string, column_name string, purpose string")
    assert got(contract.manifest(columns, uses)) == [("", "c", "empty_table_name"), ("t", "", "empty_column_name"), ("t", "a", "column_twice"), ("t", "b", "unsupported_type"), ("t", "zz", "unknown_index_column")]


def test_registering_tables(spark):
    spark.createDataFrame([("1", "u1", "x", None), ("2", "u2", "y", None), ("3", "u1", "z", "2024-01-01")], "id string, owner string, secret string, deleted_at string").createOrReplaceTempView("notes")
    known = registry.Registry(spark)
    sql = "SELECT id AS record_id, array(concat('user:', owner), 'global') AS scopes FROM notes"
    table = known.register("notes", sql, exclude=["secret"])
    assert table.columns == ("id", "owner", "deleted_at") and table.updated_at is None
    found = known.backfill()
    assert got(found.select("record_id", "scope_id")) == [("1", "global"), ("1", "user:u1"), ("2", "global"), ("2", "user:u2")]
    assert found.filter("checksum is null").count() == 0
    for wrong in ({"push_policy": "maybe"}, {"pk": "nope"}, {"exclude": ["id"]}, {"exclude": ["nope"]}, {"exclude": ["owner", "owner"]}, {"exclude": ["owner"], "columns": ["id"]}, {"columns": ["id"]}):
        with pytest.raises(ValueError):
            known.register("notes", sql, **wrong)
    with pytest.raises(ValueError):
        known.register("notes", "SELECT id FROM notes")
    for scope in (" ", "user:1"):
        with pytest.raises(ValueError):
            known.share(scope)
    known.share("global", portable=True)
    assert known.shared == {"global": True} and [c["column_name"] for c in known.manifest()] == ["id", "owner", "deleted_at"]
    assert known.unregister("notes", found).count() == 0 and not known.tables


def test_schema_versions(spark):
    history = spark.createDataFrame([(1, "a"), (2, "b")], "version int, hash string")
    assert registry.next_version(history, "a") == 1 and registry.next_version(history, "c") == 3
    assert registry.schema_hash([{"b": 1, "a": 2}]) == registry.schema_hash([{"a": 2, "b": 1}])
    kinds = "table_name string, column_name string, storage string"
    local = spark.createDataFrame([("t", "a", "TEXT")], kinds)
    for server, want in ((("t", "a", "text"), "none"), (("t", "b", "TEXT"), "add"), (("t", "a", "REAL"), "rebuild")):
        assert registry.migration(registry.schema_changes(local, spark.createDataFrame([server], kinds))) == want
    assert registry.connect_action((1, "x"), (1, "x")) == "none" and registry.connect_action((1, "x"), (1, "y")) == "replace"


def test_the_stream_keeps_going_past_bad_rows(spark, tmp_path):
    kinds = "kind string, table_name string, record_id string, deleted_at string"
    raw, log, bad = str(tmp_path / "raw"), str(tmp_path / "log"), str(tmp_path / "bad")
    spark.createDataFrame([("I", "t", "1", None), ("U", "t", "2", "x"), ("D", "t", "", None), ("B", "t", "9", None)], kinds).coalesce(1).write.parquet(raw)
    stream = spark.readStream.schema(kinds).parquet(raw)
    entries = lambda events, n: events.select("record_id", "operation")
    consume(stream, entries, log, bad, str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([("U", "t", "1", None)], kinds).write.mode("append").parquet(raw)
    consume(stream, entries, log, bad, str(tmp_path / "c")).awaitTermination()
    assert got(spark.read.parquet(log).select("record_id", "operation")) == [("1", 1), ("1", 2), ("2", 3)]
    assert spark.read.parquet(bad).count() == 1
