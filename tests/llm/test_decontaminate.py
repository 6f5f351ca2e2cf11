"""Recall of decontamination against a brute-force subsequence search over a benchmark of several hundred passages."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tests.llm.test_models import longest
from tidescope.llm import decontaminate


def test_no_copy_is_lost_in_a_space_with_fewer_axes_than_passages(spark):
    draw = random.Random(6)
    topics = [[f"t{k}w{i}" for i in range(40)] for k in range(80)]  # three passages each take the leading axes
    items = [[w for w in draw.sample(topics[i % 80], 30)] for i in range(240)]
    items += [[f"own{i}w{k}" for k in range(length)] for i, length in enumerate(draw.choices((10, 20, 40, 80), k=160))]
    items = list(enumerate(items))
    docs = []
    for i, passage in items:  # a copy, some of its words left out or replaced, among words of the other passages
        copy = [w if draw.random() > 0.1 else "other" for w in passage if draw.random() > 0.04]
        before, after = ([draw.choice(draw.choice(topics)) for _ in range(draw.randrange(0, 90))] for _ in range(2))
        docs.append((i, before + copy + after))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["lcs"] for r in decontaminate.leaks(table, bench).collect()}
    # brute force over the same windows: two to four times a passage, starting every half window
    want = {}
    split = dict(docs)
    for i, passage in items:
        n = len(passage)
        size = 16 * next(k for k, most in ((2, 16), (4, 32), (8, 64), (12, 96)) if n <= most)
        text = [w.encode() for w in split[i]]
        p = [w.encode() for w in passage]
        share = max(longest(p, text[s : s + size]) / n for s in range(0, len(text), size // 2))
        if share >= 0.8:
            want[i, i] = share
    assert len(want) > 250 and want.items() <= found.items()


def test_short_items_and_answers(spark):
    long_item = " ".join(f"q{i}" for i in range(105))
    part = " ".join(f"q{i}" if i % 3 else f"x{i}" for i in range(96))  # two thirds of the first passage
    bench = spark.createDataFrame([(1, "the sky is blue today friend ok", None), (2, long_item, "completely different reply here"), (3, "yes", "certainly not")], "item_id long, text string, answer string")
    rows = [(1, "we said: The sky is blue today, friend. OK? and went"), (2, "the sky is blue today my friend ok"), (3, part), (4, part + " so completely different reply here"), (5, "yes but no"), (6, "yes that is certainly not so")]
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert found == {(1, 1), (4, 2), (6, 3)}
    tail = spark.createDataFrame([(7, "lead " * 20 + long_item + " end" * 20)], "doc_id long, text string")
    assert [(r["item_id"], r["lcs"]) for r in decontaminate.leaks(tail, bench).collect()] == [(2, 1.0)]


def test_paraphrases_against_a_full_scan(spark):
    """Edited copies with their answer, sixty to eighty per cent in order: what a scan of every place finds, the windows find too."""
    draw = random.Random(9)
    words = [f"w{i}" for i in range(4000)]
    items = [(i, draw.sample(words, n), draw.sample(words, 5)) for i, n in enumerate(draw.choices((12, 20, 30, 45, 60, 90), k=120))]
    docs = []
    for i, passage, answer in items:
        copy = [w if draw.random() > draw.choice((0.2, 0.3, 0.4)) else draw.choice(words) for w in passage]
        filler = [draw.choice(words) for _ in range(draw.randrange(0, 120))]
        docs.append((i, filler + copy + (answer if draw.random() < 0.7 else []) + filler))
    bench = spark.createDataFrame([(i, " ".join(p), " ".join(a)) for i, p, a in items], "item_id long, text string, answer string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string"), bench).collect()}
    want = set()
    for (i, passage, answer), (_, text) in zip(items, docs, strict=True):
        n = len(passage)
        share = max(longest(passage, text[s : s + 2 * n]) / n for s in range(max(1, len(text) - n)))
        told = max(longest(answer, text[s : s + 10]) / 5 for s in range(len(text)))
        if share >= 0.8 or (share >= 0.6 and told >= 0.8):
            want.add((i, i))
    assert len(want) > 40 and len(want & found) >= 0.9 * len(want)
    assert all(a == b for a, b in found)


def searched(monkeypatch, spark, docs, bench):
    """Rows found by the search that Spark is given, run here, and how often it looked for a subsequence, by length."""
    kept, real, calls = [], type(bench).mapInArrow, Counter()
    monkeypatch.setattr(type(bench), "mapInArrow", lambda self, f, schema: kept.append(f) or real(self, f, schema))
    decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    search = decontaminate.common
    monkeypatch.setattr(decontaminate, "common", lambda where, length, words: calls.update([length]) or search(where, length, words))
    batch = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in docs], "th": [0] * len(docs), "text": [t for _, t in docs]})
    return [r for out in kept[-1](iter([batch])) for r in out.to_pylist()], calls


def test_words_that_stand_often_in_a_window_count_once(spark, monkeypatch):
    """Texts of a few of a passage's words, again and again, are not searched for the passage: most of its words are missing."""
    draw = random.Random(5)
    items = [draw.sample([f"u{i}" for i in range(400)], 30) for _ in range(60)]
    docs = []
    for i, item in enumerate(items):
        text = draw.choices(item[:8], k=800)
        if i < 10:
            text[300:330] = item
        docs.append((i, " ".join(text)))
    bench = spark.createDataFrame([(i, " ".join(w), "no such answer") for i, w in enumerate(items)], "item_id long, text string, answer string")
    found, calls = searched(monkeypatch, spark, docs, bench)
    assert sorted((r["doc_id"], r["item_id"], r["lcs"]) for r in found) == [(i, i, 1.0) for i in range(10)]
    assert 10 <= calls[30] <= 40


def test_a_window_is_searched_once(spark, monkeypatch):
    """A long text repeats a passage beyond the windows that are taken at a time."""
    item = [f"w{i}" for i in range(15)]
    bench = spark.createDataFrame([(1, " ".join(item), "no such answer")], "item_id long, text string, answer string")
    found, calls = searched(monkeypatch, spark, [(1, " ".join([*item, "and"] * 6000))], bench)
    assert [(r["item_id"], r["lcs"]) for r in found] == [(1, 1.0)]
    assert calls[15] == 6000


def test_sums_of_steps_and_windows():
    draw = np.random.default_rng(4)
    table, ids = draw.integers(0, 16, (50, 7)).astype(np.uint8), draw.integers(0, 50, 400)
    edge = np.unique(np.r_[0, draw.integers(1, 400, 120)])
    sums = decontaminate.by_step(table, ids, edge)
    assert (sums == np.array([table[part].sum(0, dtype=np.uint8) for part in np.split(ids, edge[1:])])).all()
    steps = draw.random((24, 3))
    for half in (1, 2, 4, 6):
        assert np.allclose(decontaminate.halves(steps, half), steps.reshape(-1, half, 3).sum(1))
