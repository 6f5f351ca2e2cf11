"""Incremental removal of repeated passages with a log-structured index of fingerprints.

Every window of 50 words selects the 16-word gram in it with the smallest hash (a minimizer), so equal windows select equal
grams at the same place. Of a document, only these anchors are indexed: the gram's rolling hash, and a
digest of the words within reach of it (the anchor's context, up to 84 words: every window that can select the anchor).

The index is a list of immutable runs (hash, context, smallest doc_id), each a table bucketed and sorted by hash, so that a batch is
merge-joined with a run without moving the run. A batch of documents, whose doc_ids follow those before it, goes
through these steps:

1. anchors of the batch meet each other and the runs;
2. an anchor whose whole context has a smaller owner is verified by the context's digest: all its windows are repeats;
3. where one hash has several contexts (edges of passages, edits), the documents that own them are read again, new and old (texts
   that aren't needed again don't move), and
   their windows that select the anchor are compared word for word by a 128-bit digest of the bytes;
4. words under repeated windows go; contexts not known before become a new run, and runs are merged when they are many.

Counts are pre-aggregated by key, so a passage in a third of all documents is one context with one owner, and a context that more than a
thousandth of all anchors have meets them by broadcast. No owner, candidate or window is capped; the result is exact.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Defined cases: null and empty texts have no words; under 50 words nothing is removed; a
null doc_id is neither an owner nor loses words; rows that repeat a doc_id don't remove each other's words; an empty table gives an
empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescope.llm.common import (
    cut,
    drop_table,
    join_hot,
    likely,
    path_exists,
    shared_dir,
    shuffles_go,
    slices,
)

WINDOW, GRAM = 50, 16
REACH = WINDOW - GRAM  # words on either side of an anchor that its windows cover
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
REMEMBERED = 500_000
RESULT = "doc_id long, th int, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>"

_hashes: dict[bytes, int] = {}
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        for i, b in enumerate((BASE, INVERSE)):
            steps = np.full(2 * n, b, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    for w in {*words}.difference(_hashes) if len(words) > 8 * len(_hashes) else [w for w in {*words} if w not in _hashes]:
        _hashes[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def selected(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The place of the gram that each window of ``words`` selects, the leftmost of equal hashes; and the hashes of all grams."""
    n = len(words)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word_hashes(words) * up[:n], dtype=np.uint64)])
    grams = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(29)
    seen = np.lib.stride_tricks.sliding_window_view(grams, REACH + 1)
    places = []
    for at in range(0, len(seen), 1 << 15):
        places.append(seen[at : at + (1 << 15)].argmin(1) + np.arange(at, min(len(seen), at + (1 << 15))))
    return np.concatenate(places), grams


def anchors(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that the windows of ``words`` select."""
    places, grams = selected(words)
    places = np.unique(places)
    return places, grams[places].view(np.int64)


def laid(words: list[bytes]) -> tuple[bytes, list[int]]:
    """The words joined by spaces, and where each starts; words i to j - 1 are ``joined[at[i] : at[j] - 1]``."""
    return b" ".join(words), [0, *np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1).tolist()]


def context(joined: bytes, at: list[int], place: int) -> int:
    """Digest of the words that windows around the anchor at ``place`` can hold, and of where the anchor is in them."""
    lo, hi = max(0, place - REACH), min(len(at) - 1, place + WINDOW)
    raw = hashlib.blake2b(joined[at[lo] : at[hi] - 1], digest_size=8, salt=(place - lo).to_bytes(2, "little")).digest()
    return int.from_bytes(raw, "little", signed=True)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def sketches(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, th (hash of the text), n_words, sha256 of the words, and its anchors (place, h, ctx)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            count, sha, ends, place, h, ctx = [], [], [0], [], [], []
            for text in batch.column("text").to_pylist():
                words = split(text)
                count.append(len(words))
                joined, at = laid(words)
                sha.append(hashlib.sha256(joined).hexdigest())
                places, own = anchors(words)
                place.append(places)
                h.append(own)
                ctx.extend(context(joined, at, a) for a in places.tolist())
                ends.append(ends[-1] + len(places))
            rows = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(place).astype(np.int32)), pa.array(np.concatenate(h)), pa.array(ctx, pa.int64())], names=["place", "h", "ctx"]
            )
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(count, pa.int64()), pa.array(sha), lists], names=["doc_id", "th", "n_words", "sha", "anchors"]
            )

    kinds = "doc_id long, th int, n_words long, sha string, anchors array<struct<place:int,h:bigint,ctx:bigint>>"
    return keyed(docs).mapInArrow(run, kinds)


def keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.hash(text).alias("th"))


class Index:
    """Sorted immutable runs of (h, ctx, doc_id), bucketed by h. ``fanout``: runs that are merged into one.

    With a ``folder`` the index outlives the session: runs lie there, and after every change the list of runs is stored anew, the latest of which
    a later session opens.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4, folder: str | None = None):
        self.spark, self.fanout, self.folder, self.runs, self.version = spark, fanout, folder, [], 0
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        if folder and path_exists(spark, f"{folder}/lists"):
            listed = spark.read.schema("path string, buckets int, version int").parquet(f"{folder}/lists")
            self.version = listed.agg(F.max("version")).first()[0]
            for r in listed.filter((F.col("version") == self.version) & F.col("path").isNotNull()).collect():  # a row for each run
                name = f"run_{uuid.uuid4().hex}"
                spark.sql(f"CREATE TABLE {name} (h BIGINT, ctx BIGINT, doc_id BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {r['buckets']} BUCKETS LOCATION '{r['path']}'")
                self.runs.append((name, r["path"]))
                self.buckets = r["buckets"]

    def listed(self) -> None:
        if self.folder:
            self.version += 1
            rows = [(path, self.buckets, self.version) for _, path in self.runs] or [(None, self.buckets, self.version)]
            self.spark.createDataFrame(rows, "path string, buckets int, version int").coalesce(1).write.mode("append").parquet(f"{self.folder}/lists")

    def add(self, rows: DataFrame) -> None:
        name = f"run_{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}" if self.folder else shared_dir(self.spark)
        dealt = rows.select("h", "ctx", "doc_id").repartition(self.buckets, "h")
        dealt.write.bucketBy(self.buckets, "h").sortBy("h").option("path", path).format("parquet").saveAsTable(name)
        self.runs.append((name, path))
        if len(self.runs) > self.fanout:
            self.compact()
        else:
            self.listed()

    def compact(self) -> None:
        """Merge all runs into one; the old ones go only when the new one is written."""
        old, self.runs = self.runs, []
        every = [self.spark.table(name) for name, _ in old]
        merged = every[0]
        for run in every[1:]:
            merged = merged.union(run)
        self.add(merged.groupBy("h", "ctx").agg(F.min("doc_id").alias("doc_id")))
        self.drop(old)

    def drop(self, runs: list[tuple[str, str]] | None = None) -> None:
        for name, path in self.runs if runs is None else runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_table(self.spark, path)
        if runs is None:
            self.runs = []

    def matches(self, keys: DataFrame) -> DataFrame:
        """Rows of every run whose h is among ``keys``."""
        found = self.spark.createDataFrame([], "h long, ctx long, doc_id long")
        for name, _ in self.runs:
            found = found.union(self.spark.table(name).join(keys, "h", "left_semi").select("h", "ctx", "doc_id"))
        return found


def windows(store: DataFrame) -> DataFrame:
    """(w1, w2, doc_id, th, start): the windows of each stored document that select a wanted anchor (h, ctx)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digests, starts, docs, counts = [], [], [], []
            for d, th, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "text", "wanted")), strict=True):
                keys = {(w["h"], w["ctx"]) for w in wanted or ()}
                if not keys:
                    continue
                words = split(text)
                held = {h for h, _ in keys}
                joined, at = laid(words)
                picked, grams = selected(words)
                places = np.unique(picked)
                found = [a for a, h in zip(places.tolist(), grams[places].view(np.int64).tolist(), strict=True) if h in held and (h, context(joined, at, a)) in keys]
                own = np.flatnonzero(np.isin(picked, found))
                digests.extend(hashlib.blake2b(joined[at[s] : at[s + WINDOW] - 1], digest_size=16).digest() for s in own.tolist())
                starts.append(own)
                docs.append((d, th))
                counts.append(len(own))
            if digests:
                w1, w2 = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2).T
                d, th = (np.repeat(np.array(x, kind), counts) for x, kind in zip(zip(*docs, strict=True), (np.int64, np.int32), strict=True))
                columns = [pa.array(np.ascontiguousarray(x)) for x in (w1, w2, d, th, np.concatenate(starts).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["w1", "w2", "doc_id", "th", "start"])

    return store.select("doc_id", "th", "text", "wanted").mapInArrow(run, "w1 long, w2 long, doc_id long, th int, start int")


def cleaned(store: DataFrame) -> DataFrame:
    """Rows of ``RESULT`` for stored documents with anchors ``places`` whose reach goes and window ``starts`` that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for d, th, text, places, starts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "text", "places", "starts")), strict=True):
                words = split(text)
                change = np.zeros(len(words) + 1, np.int64)
                for lo, hi in [(max(0, a - REACH), min(len(words), a + WINDOW)) for a in places or ()] + [(s, s + WINDOW) for s in starts or ()]:
                    change[lo] += 1
                    change[hi] -= 1
                gone = np.cumsum(change)[:-1] > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans = [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]
                rows.append({"doc_id": d, "th": th, "n_words": len(words), "n_removed": int(gone.sum()), "kept_sha256": hashlib.sha256(kept).hexdigest(), "spans": spans})
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("th", pa.int32()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", span)]))

    return store.select("doc_id", "th", "text", "places", "starts").mapInArrow(run, RESULT)


def process(batch: DataFrame, corpus: DataFrame, index: Index) -> DataFrame:
    """One batch: a row of ``RESULT`` for every row of ``batch``; the index then holds the batch too.

    ``corpus``: documents to which the index and the batch point, the batch included. doc_ids of the batch must not lie under those before.
    """
    with shuffles_go(batch.sparkSession):
        return take(batch, corpus, index)


def take(batch: DataFrame, corpus: DataFrame, index: Index) -> DataFrame:
    spark, base = batch.sparkSession, shared_dir(batch.sparkSession)
    sketch = cut(sketches(batch), f"{base}/sketches")
    each = sketch.filter("doc_id is not null").select("doc_id", "th", F.explode("anchors").alias("a")).select("doc_id", "th", "a.place", "a.h", "a.ctx")
    own = cut(each.groupBy("h", "ctx").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"), F.count("*").alias("n")), f"{base}/own")
    past = cut(index.matches(own.select("h").distinct()), f"{base}/past") if index.runs else index.matches(own)
    met = own.select("h", "ctx", "doc_id", "last", "n").union(past.select("h", "ctx", "doc_id", F.col("doc_id").alias("last"), F.lit(0).cast("long")))
    met = met.groupBy("h", "ctx").agg(F.min("doc_id").alias("owner"), F.max("last").alias("last"), F.sum("n").alias("n"))
    shared = met.filter("owner < last and n > 0").select("h", "ctx", "owner", "n")
    total, low = own.agg(F.coalesce(F.sum("n"), F.lit(0)), F.min("doc_id")).first()
    several = met.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    covered = join_hot(each, shared, ["h", "ctx"], "n", total).filter("owner < doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("th", "place")).alias("covered"))
    owners = met.join(several, "h", "left_semi").groupBy(F.col("owner").alias("doc_id")).agg(F.collect_list(F.struct("h", "ctx")).alias("wanted"))
    needs = cut(covered.join(owners, "doc_id", "full"), f"{base}/needs")
    store = cut(likely(keyed(corpus), needs, "doc_id").join(needs, "doc_id"), f"{base}/store")
    mine = F.col("doc_id") >= F.lit(low)  # documents before the batch have their rows
    every = cut(windows(store), f"{base}/windows")
    first = every.groupBy("w1", "w2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter("owner < last")
    repeats = every.join(first, ["w1", "w2"]).filter("owner < doc_id").filter(mine).groupBy("doc_id", "th").agg(F.collect_set("start").alias("starts"))
    places = F.expr("transform(filter(covered, c -> c.th = th), c -> c.place)")
    ready = store.filter(mine).withColumn("places", places).join(repeats, ["doc_id", "th"], "left").filter("size(places) > 0 or starts is not null")
    changed = cleaned(ready).dropDuplicates(["doc_id", "th"]).select("doc_id", "th", "n_removed", "kept_sha256", "spans")
    rows = sketch.select("doc_id", "th", "n_words", "sha").join(changed, ["doc_id", "th"], "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    result = cut(
        rows.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("spans", none).alias("spans")),
        f"{shared_dir(spark)}",
    )
    index.add(own.select("h", "ctx", "doc_id").join(past, ["h", "ctx"], "left_anti"))
    drop_table(spark, base)
    return result


def deduplicate(docs: DataFrame, batches: int = 2, fanout: int = 4) -> DataFrame:
    """Take ``docs`` in ``batches`` by doc_id through :func:`process`; a row per document: doc_id, n_words, n_removed, kept_sha256, spans."""
    index = Index(docs.sparkSession, fanout)
    marks = docs.select(F.col("doc_id").cast("double")).approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    marks = [int(m) for m in dict.fromkeys(marks)]
    done, low = None, None
    for high in [*marks, None]:
        own = F.lit(True)
        if low is not None:
            own = own & (F.col("doc_id") > low)
        if high is not None:
            own = own & (F.col("doc_id") <= high)
        else:
            own = own | F.col("doc_id").isNull()
        corpus = docs if high is None else docs.filter(F.col("doc_id") <= high)
        part = process(docs.filter(own), corpus, index)
        done = part if done is None else done.union(part)
        low = high
    index.drop()
    return done
