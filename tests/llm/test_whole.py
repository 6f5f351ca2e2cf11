"""Operators whose results a plain program or SQL can give in full, over the test tables and odd rows."""

import hashlib
import os
import random
import time
import zlib
from collections import defaultdict

import xxhash

from tests.compare import DATA, expected, rows_of
from tidescope.llm import exact_dedup, queries, sharding, simhash, substring_dedup
from tidescope.llm.common import likely

SF = str(DATA / "sf0.001")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    for c in SPACE[1:]:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# --- sharding ---------------------------------------------------------------------------------------------------------


def check_shards(rows, tolerance=0.25):
    """rows: (shard, slot, size); slots are gapless and shards near equal."""
    slots, bytes_ = defaultdict(list), defaultdict(int)
    for shard, slot, size in rows:
        slots[shard].append(slot)
        bytes_[shard] += size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return bytes_


def test_shards_hold_every_row_and_near_equal_bytes(spark):
    found = queries.op2_histogram_sharding(spark, SF).collect()
    want = {d: t or "" for d, t in pairs(docs(spark))}
    assert len(found) == len(want)
    for r in found:
        raw = want[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "bytes")
    held = check_shards([(r["shard"], r["slot"], r["size"]) for r in found])
    most = max(r["size"] for r in found)
    assert max(held.values()) - min(held.values()) <= 2 * most + 0.01 * sum(held.values())


def test_equal_texts_lie_together_and_hot_groups_are_split(spark):
    rows = [(i, "hot" * 50 if i % 3 else f"text {i} " * 20) for i in range(3000)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).select("row.doc_id", "row.text", "shard", "slot").collect()
    held = check_shards([(r["shard"], r["slot"], len(r["text"]) + 1) for r in found])
    assert len(held) == 8 and max(held.values()) - min(held.values()) < 1000
    shards = sorted({r["shard"] for r in found if r["text"].startswith("hot")})
    assert shards == list(range(shards[0], shards[-1] + 1))


def test_small_parts_give_the_same_law(spark):
    found = sharding.shard(docs(spark), 4, part_bytes=20_000)
    check_shards([(r["shard"], r["slot"], 1) for r in found.select("shard", "slot").collect()])
    assert found.count() == docs(spark).count()


def test_shards_of_odd_rows(odd, none):
    found = sharding.shard(odd, 8)
    assert found.count() == odd.count()
    assert found.select("row.*").columns == odd.columns
    check_shards([(r["shard"], r["slot"], 1) for r in found.collect()])
    assert sharding.shard(none, 8).count() == 0


# --- exact deduplication ------------------------------------------------------------------------------------------------


def test_exact_dedup_equals_its_sql(spark):
    found = queries.op4_streaming_exact_dedup(spark, SF)
    names, want = expected(queries.ORACLE_SQL["op4_streaming_exact_dedup"], "sf0.001")
    assert sorted(found.columns) == names
    assert rows_of(found.columns, found.collect()) == want


def plain_groups(rows):
    by = defaultdict(list)
    for d, t in rows:
        by[lower(t)].append(d)
    return sorted(
        ((d, max((x for x in by[lower(t)] if x is not None), default=None), len(by[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for d, t in rows), key=repr
    )


def test_digests_that_collide_are_told_apart(odd):
    for digits in (64, 1):  # with one digit of the digest as key, hits differ in their bytes
        found = exact_dedup.dedup(odd, digits).select("doc_id", "keep_id", "group_size", "text_sha256").collect()
        assert sorted(map(tuple, found), key=repr) == plain_groups(pairs(odd)), digits


def test_repeated_ids_with_different_texts_are_rows_of_their_own(spark):
    rows = [(1, "aaa"), (1, "bbb"), (2, "aaa"), (3, "bbb"), (4, "c"), (None, "c"), (None, "d"), (None, "D")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for digits in (64, 1):
        found = exact_dedup.dedup(table, digits).select("doc_id", "keep_id", "group_size", "text_sha256").collect()
        assert sorted(map(tuple, found), key=repr) == plain_groups(rows), digits
    assert sorted(map(tuple, exact_dedup.keep(table).collect()), key=repr)[:3] == [(2, "aaa"), (3, "bbb"), (4, "c")]
    assert exact_dedup.keep(table).count() == 4


def test_a_second_call_meets_the_first_one_s_state(spark, tmp_path):
    for digits in (64, 1):
        folder, first, second = str(tmp_path / f"state{digits}"), str(tmp_path / f"first{digits}"), str(tmp_path / f"second{digits}")
        old, new = [(5, "a"), (2, "b"), (2, "a"), (9, "q")], [(7, "B"), (1, "a"), (3, "new"), (None, "b")]
        for rows, path in ((old, first), (new, second)):
            spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
        found = exact_dedup.dedup(spark.read.parquet(first), digits, folder=folder)
        assert sorted(map(tuple, found.select("doc_id", "keep_id", "group_size", "text_sha256").collect()), key=repr) == plain_groups(old)
        found = exact_dedup.dedup(spark.read.parquet(second), digits, folder=folder, corpus=spark.read.parquet(first, second))
        want = [r for r in plain_groups(old + new) if (r[0], r[3]) in {(d, hashlib.sha256(lower(t).encode()).hexdigest()) for d, t in new}]
        assert sorted(map(tuple, found.select("doc_id", "keep_id", "group_size", "text_sha256").collect()), key=repr) == want


def test_keep_leaves_one_row_of_each_text_with_its_columns(odd, none):
    found = exact_dedup.keep(odd)
    assert found.columns == odd.columns
    rows = pairs(found)
    assert len(rows) == len({lower(t) for _, t in pairs(odd)}) == len({lower(t) for _, t in rows})
    assert exact_dedup.dedup(none).count() == 0 and exact_dedup.keep(none).count() == 0


def test_texts_without_a_copy_are_not_moved(spark, tmp_path):
    draw, path, limit = random.Random(3), str(tmp_path / "documents"), "spark.sql.autoBroadcastJoinThreshold"
    rows = [(i, f"{draw.getrandbits(8000):x}") for i in range(4000)]
    rows += [(4000 + i, rows[i][1].upper()) for i in range(20)] + [(7, rows[7][1])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    moved = lambda: spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before, start = spark.conf.get(limit), moved()
    spark.conf.set(limit, "-1")  # as over tables that are too large for it
    try:
        docs = spark.read.parquet(path)
        found = exact_dedup.dedup(docs).select("doc_id", "keep_id", "group_size", "text_sha256").collect()
        assert sorted(map(tuple, found), key=repr) == plain_groups(rows)
        kept = exact_dedup.keep(docs).collect()
    finally:
        spark.conf.set(limit, before)
    assert sorted(map(tuple, kept)) == sorted(rows[20:4000] + rows[4000:4020])
    time.sleep(1)  # the figures follow the tasks
    assert 0 < moved() - start < 4_000_000  # the texts alone take 4 MB when compressed and were moved three times


def test_state_goes_on_with_new_files_alone(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    first = exact_dedup.digests(spark.createDataFrame([(5, "a"), (2, "b")], "doc_id long, text string"))
    first.write.parquet(source)
    exact_dedup.retain(spark, source, first.schema, state)
    exact_dedup.digests(spark.createDataFrame([(9, "B"), (7, "c")], "doc_id long, text string")).write.mode("append").parquet(source)
    found = exact_dedup.retain(spark, source, first.schema, state).collect()
    assert sorted((r["keep_id"], r["group_size"]) for r in found) == [(5, 1), (7, 1), (9, 2)]


# --- substring deduplication -------------------------------------------------------------------------------------------


def plain_substrings(rows, window=50):
    split = [(d, words(t)) for d, t in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def taken(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


def test_substrings_equal_brute_force(spark):
    want = plain_substrings(pairs(docs(spark)))
    assert any(r[2] for r in want)
    assert taken(queries.op7_incremental_substring_dedup(spark, SF)) == want


def test_substrings_over_many_batches_and_merged_runs(spark):
    import random

    draw = random.Random(3)
    block = [[f"w{draw.randrange(400)}" for _ in range(draw.randrange(45, 90))] for _ in range(12)]
    rows = []
    for i in range(150):
        text = [f"w{draw.randrange(400)}" for _ in range(draw.randrange(0, 30))]
        for _ in range(draw.randrange(0, 4)):
            part = list(draw.choice(block))
            if draw.random() < 0.3:
                part[draw.randrange(len(part))] = "edit"
            text += part + [f"w{draw.randrange(400)}" for _ in range(draw.randrange(0, 12))]
        rows.append((i, " ".join(text)))
    rows += [(200, "same " * 300), (201, "same " * 120), (202, "ab " * 80)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_substrings(rows)
    for batches, fanout in ((1, 4), (5, 2)):
        assert taken(substring_dedup.deduplicate(table, batches, fanout)) == want


def test_substrings_of_odd_rows(odd, none):
    assert taken(substring_dedup.deduplicate(odd)) == plain_substrings(pairs(odd))
    assert substring_dedup.deduplicate(none).count() == 0


def test_texts_without_repeats_stay_and_shuffle_files_go(spark, tmp_path):
    draw, path, limit = random.Random(4), str(tmp_path / "documents"), "spark.sql.autoBroadcastJoinThreshold"
    rows = [(i, " ".join(f"{draw.getrandbits(160):x}" for _ in range(60))) for i in range(2000)]
    rows += [(2000 + i, f"edge{i} {rows[i][1]} end") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    moved = lambda: spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    shuffled = lambda: {f for top in folders for _, _, files in os.walk(top) for f in files if f.startswith("shuffle_") and f.endswith(".data")}
    before, start, there = spark.conf.get(limit), moved(), shuffled()
    spark.conf.set(limit, "-1")  # as over tables that are too large for it
    try:
        found = substring_dedup.deduplicate(spark.read.parquet(path))
        time.sleep(1)  # files go and figures follow shortly after
        left = shuffled() - there
        assert taken(found) == plain_substrings(rows)
    finally:
        spark.conf.set(limit, before)
    assert not left
    assert 0 < moved() - start < 2_500_000  # 8.2 MB when all texts (4.9 MB) were moved


def test_the_likely_filter_loses_no_key(spark):
    rows = spark.range(-5000, 5000).selectExpr("id AS doc_id", "id AS part", "'x' AS row").union(spark.sql("SELECT CAST(null AS long), 1L, 'y'"))
    keys = spark.range(-2000, 2000, 4).selectExpr("id AS doc_id").union(spark.sql("SELECT CAST(null AS long)"))
    found = likely(rows, keys, "doc_id")
    assert found.columns == rows.columns
    taken = [r["doc_id"] for r in found.collect()]
    assert {*range(-2000, 2000, 4)} <= {*taken} and len(taken) < 1010 and None not in taken
    assert likely(rows, keys.limit(0), "doc_id").count() == 0


# --- SimHash ----------------------------------------------------------------------------------------------------------------


def plain_print(text):
    w = words(lower(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(rows):
    prints = [(d, plain_print(t)) for d, t in rows]
    kinds = sorted({p for _, p in prints})
    root = {k: k for k in kinds}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    low = {}
    for d, p in prints:
        if d is not None:
            low[find(p)] = min(low.get(find(p), d), d)
    return sorted(((d, f"{p:016x}", low.get(find(p))) for d, p in prints), key=repr)


def test_classes_equal_brute_force(spark, odd, none):
    found = queries.op10_simhash_components(spark, SF)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_classes(pairs(docs(spark)))
    found = simhash.classes(odd).select("doc_id", simhash.hex_digits("fp"), "component_id")
    assert sorted(map(tuple, found.collect()), key=repr) == plain_classes(pairs(odd))
    assert simhash.classes(none).count() == 0


def test_chains_of_fingerprints_become_one_component(spark):
    import random

    draw = random.Random(5)
    prints = {0}
    at = 0
    for _ in range(60):  # a long chain, each two bits from the one before
        at ^= 1 << draw.randrange(64) | 1 << draw.randrange(64)
        prints.add(at)
    prints |= {draw.getrandbits(64) for _ in range(200)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    near = {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2}
    root = {p: p for p in prints}

    def find(r, k):
        while r[k] != k:
            k = r[k]
        return k

    for a, b in near:
        root[find(root, a)] = find(root, b)
    own = {p: p for p in prints}
    for r in found:
        a, b = r["a"] % (1 << 64), r["b"] % (1 << 64)
        assert (a ^ b).bit_count() <= 2
        own[find(own, a)] = find(own, b)
    parts = lambda r: {frozenset(q for q in prints if find(r, q) == find(r, p)) for p in prints}
    assert parts(own) == parts(root)


def test_substrings_equal_their_sql(spark):
    found = queries.op7_incremental_substring_dedup(spark, SF)
    names, want = expected(queries.ORACLE_SQL["op7_incremental_substring_dedup"], "sf0.001")
    assert sorted(found.columns) == names
    assert rows_of(found.columns, found.collect()) == want


def test_an_index_is_opened_again(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"a {passage}"), (2, "other words"), (3, f"b {passage} c"), (4, passage)], "doc_id long, text string")
    folder = str(tmp_path / "index")
    first = substring_dedup.process(docs.filter("doc_id <= 2"), docs.filter("doc_id <= 2"), substring_dedup.Index(spark, 1, folder))
    assert sorted((r["doc_id"], r["n_removed"]) for r in first.collect()) == [(1, 0), (2, 0)]
    again = substring_dedup.Index(spark, 1, folder)
    assert len(again.runs) == 1
    second = substring_dedup.process(docs.filter("doc_id = 3"), docs.filter("doc_id <= 3"), again)  # two runs are merged into one
    assert [(r["doc_id"], r["n_removed"]) for r in second.collect()] == [(3, 60)]
    third = substring_dedup.Index(spark, 1, folder)
    assert len(third.runs) == 1 and third.version > again.version - 1
    last = substring_dedup.process(docs.filter("doc_id = 4"), docs, third)
    assert [(r["doc_id"], r["n_removed"]) for r in last.collect()] == [(4, 60)]
