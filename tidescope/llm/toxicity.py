"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled texts: one on windows of ordinary texts, one on those words of toxic
texts that stand out there (a two-proportion z test over words and word beginnings). A window of 10 words is compressed with the
ordinary dictionary alone and with the toxic one in front of it; the bytes that the toxic dictionary saves are the window's
distance. The largest, the means and the sum of a text's distances go through a logistic calibration, fitted on the same labelled
rows, to a score from 0 to 1. Choosing the words is a departure from training on all toxic text: see the README for the figures of both.

Labels are learnt from at most ``per_class`` rows of each class, taken in order of a hash of doc_id, and classes are weighted
back to their shares. Their texts stay on the executors: the driver gets counts of at most ``most`` words, at most ``samples`` windows of at
most ``WIDEST`` bytes, and the seven distances of each training row. Scoring reads every whole text, and nothing but the text.

Defined cases: null and empty texts score like a text without a toxic word; without training rows of both classes every score
is 0; a null doc_id is never a training row. Extra columns are not read.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidescope.llm.common import cut, drop_table, shared_dir, slices

WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (5, 6, 7, 8)
WINDOW, WIDEST = 10, 512


@dataclass(frozen=True)
class Model:
    """What a scorer needs: two dictionaries' contents, the window, and the calibration (means, scales, weights)."""

    ordinary: bytes = b""
    toxic: bytes = b""
    window: int = WINDOW
    mean: tuple = ()
    scale: tuple = ()
    weights: tuple = ()


def windows(text: str | None, size: int) -> list[bytes]:
    words = (text or "").lower().split()
    return [" ".join(words[i : i + size]).encode("utf-8", "replace") for i in range(0, len(words), size)]


def signs(word: str) -> set[str]:
    return {word} | {word[:k] + "*" for k in BEGINNINGS if len(word) > k}


def telling(rows: DataFrame, count: dict[int, int], least_share: float = 0.01, least_z: float = 4.0, most: int = 300) -> set[str]:
    """Words and beginnings (``abcde*``) that stand out in the toxic ones of ``rows`` (text, toxic), the most significant first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = list(set().union(*map(signs, set(WORD.findall(text.lower())))))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([toxic] * len(own), pa.int32())], names=["sign", "toxic"])

    a, b, n, m = F.col("a"), F.col("b"), F.lit(count[1]), F.lit(count[0])
    p = (a + b) / (n + m)
    z = (a / n - b / m) / F.sqrt(p * (1 - p) * (1 / n + 1 / m) + 1e-12)
    seen = rows.mapInArrow(run, "sign string, toxic int").groupBy("sign").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    told = seen.filter(a >= max(5, least_share * count[1])).withColumn("z", z).filter(F.col("z") >= least_z).filter(a / n >= 4.5 * (b + 0.5) / (m + 1))
    return {r["sign"] for r in told.orderBy(F.desc("z"), "sign").limit(most).collect()}


def told_words(rows: DataFrame, marks: set[str], most: int = 5000) -> list[tuple[str, int]]:
    """The toxic rows' words that ``marks`` name, with their counts, the most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [w for t in batch.column("text").to_pylist() for w in WORD.findall(t.lower()) if signs(w) & marks]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["word"])

    found = rows.filter("toxic = 1").mapInArrow(run, "word string").groupBy("word").agg(F.count("*").alias("n"))
    return sorted((r["word"], r["n"]) for r in found.orderBy(F.desc("n"), "word").limit(most).collect())


def ordinary_windows(rows: DataFrame, samples: int) -> list[bytes]:
    """Windows of the ordinary rows, as many as ``samples``, in order of a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([w for w in windows(text, WINDOW) if len(w) <= WIDEST], pa.binary())], names=["window"])

    found = rows.filter("toxic = 0").mapInArrow(run, "window binary").select("window", F.xxhash64("window").alias("h"))
    return [bytes(r["window"]) for r in found.orderBy("h", "window").limit(samples).collect()]


def dictionary(samples: list[bytes], size: int, **how: int) -> bytes:
    """A dictionary's bytes; samples too few to train on are taken as they are."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def compressor(content: bytes):
    how = zstandard.ZstdCompressionParameters.from_level(12, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(content) > 8 else None
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how).compress


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.plain, self.toxic = compressor(model.ordinary), compressor(model.toxic + model.ordinary)

    def features(self, text: str | None) -> np.ndarray:
        plain, toxic = self.plain, self.toxic
        saved = np.array([len(plain(w)) - len(toxic(w)) for w in windows(text, self.model.window)] or [0], float)
        top = np.sort(saved)[::-1]
        much = math.log1p(saved[saved >= 3].sum())
        return np.array([top[0], top[:3].mean(), top[:6].mean(), saved.mean(), much, much / math.log(2 + len(saved)), math.log1p(len(saved))])

    def score(self, text: str | None) -> float:
        if not self.model.weights:
            return 0.0
        x = (self.features(text) - self.model.mean) / self.model.scale
        z = float(x @ np.array(self.model.weights[:-1]) + self.model.weights[-1])
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def calibrated(model: Model, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """The model with a logistic regression of the classes ``y`` on the distances ``x``."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z, beta = np.c_[(x - mean) / scale, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        slope = z.T @ (weight * (p - y)) + 0.01 * beta
        beta -= np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(len(beta)), slope)
    return Model(model.ordinary, model.toxic, model.window, tuple(mean), tuple(scale), tuple(beta))


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, samples: int = 60_000, ordinary_bytes: int = 65536, toxic_bytes: int = 8192) -> Model:
    """Train on at most ``per_class`` labelled rows of each class outside the held-out third."""
    spark = docs.sparkSession
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id"))).distinct()
    count = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    some = [usable.filter(F.col("toxic") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    sample = F.broadcast(some[0].union(some[1]))  # at most 2 * per_class rows of two numbers
    path = shared_dir(spark)
    # a copy of a text tells nothing new; the rows are few and their texts stay where executors read them
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sample, "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    rows = cut(rows, path)
    held = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(held) < 2:
        return Model()
    told = told_words(rows, marks) if (marks := telling(rows, held)) else []
    toxic = [f" {w} ".encode() for w, n in told for _ in range(min(n, 25))]
    random.Random(7).shuffle(toxic)
    toxic *= max(1, samples // max(1, len(toxic)))
    model = Model(dictionary(ordinary_windows(rows, samples), ordinary_bytes, k=64, d=6), dictionary(toxic, toxic_bytes, k=32, d=6) if toxic else b"")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches):
            x = [scorer.features(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    found = sorted((r["toxic"], tuple(r["x"])) for r in rows.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "toxic int, x array<double>").collect())
    drop_table(spark, path)
    y = np.array([t for t, _ in found], float)
    return calibrated(model, np.array([x for _, x in found]), y, np.array([max(1.0, count[t] / per_class) for t, _ in found]))


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (text and any other columns) with the whole text's score in its place, in one pass."""
    held = rows.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size and a few numbers
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in slices(batches):
            found = pa.array([scorer.score(t) for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), found], names=[*names, "score"])

    return rows.mapInArrow(run, T.StructType([*(f for f in rows.schema if f.name != "text"), T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``docs``, from its whole text."""
    return scored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model)


def below(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score less than ``threshold``, each judged by its own text, with all columns; no exchange."""
    rows = scored(docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text")), model)
    return rows.filter(F.col("score") < threshold).select("row.*")
