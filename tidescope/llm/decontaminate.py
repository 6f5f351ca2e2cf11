"""Benchmark decontamination by latent semantic retrieval.

Benchmark texts are cut into passages of 96 words, a last one of under 8 going with the one before. TF-IDF weights use document frequencies counted over
all documents; words in more than a tenth of them are left out of the space (unless a passage has no others). A distributed randomised SVD of the passages gives the latent space: each round is a Spark job over the
passages that sums ``A^T (A W)`` by task. Every document is then slid over in windows of two to four times a
passage's length, folded into the space, and compared by cosine with the passages of that length. The space has fewer axes than a
block has passages, so a copy can lie far from its passage; every window therefore also has its words counted that a passage holds, and one that
reaches the count without which no match is possible is checked as well, however far it is. Of both, windows that lack too many of the passage's
different words go, since no match is possible without them; the others are
checked by the longest common subsequence of words: a passage counts as leaked with 80 % of its words in
order, or as a paraphrase with 60 % of its words and 80 % of the item's answer (the ``answer`` column where the benchmark has
one, else the item's last sentence) in order in the window or within some window of twice the answer's length elsewhere in the document. Items
of under 8 words are too short for that: they count as leaked where their words stand one after another, with their answer if the benchmark has any.

The benchmark is a stated query set, taken in blocks of at most ``block_words`` words: what is broadcast is bounded by that,
and every further block is one more pass. Words are lower-cased and parted by ASCII characters that are neither letters nor digits.

Defined cases: null or empty texts on either side match nothing; repeated documents and repeated items each get their own rows; a null doc_id is reported as null and never removed;
empty tables give an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidescope.llm.common import slices, text_key

#: ASCII characters that are no letter or digit part words.
PARTS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
STEP, LEAST = 16, 8
#: Steps of the widest window; each text takes a multiple of so many.
MOST = 12
#: So many passages have their words counted at a time.
WIDE = 256
FOUND = "doc_id long, th long, item_id long, cosine double, lcs double, answer_lcs double"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(PARTS).split()


def passages(items: list[tuple], most: int = 96, least: int = LEAST) -> list[tuple[int, list[bytes], list[bytes]]]:
    """(item_id, words, answer words) of every passage of (item_id, text, answer or None) rows."""
    out = []
    for item, text, answer in items:
        words = words_of(text)
        last = words_of(answer) or next((s for s in map(words_of, reversed(re.split(r"[.!?]\s", text or ""))) if s), [])
        starts = [at for at in range(0, len(words), most) if not at or len(words) - at >= least]
        out += [(item, words[a:b], last) for a, b in zip(starts, [*starts[1:], len(words)])]  # noqa: B905
    return out


def positions(a: list[bytes]) -> dict[bytes, int]:
    """For each word of ``a`` the bits of its places."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    return where


def common(where: dict[bytes, int], length: int, b: list[bytes]) -> int:
    """Length of the longest common subsequence of ``b`` and the ``length`` words whose places ``where`` has."""
    row = full = (1 << length) - 1
    for w in b:
        if m := where.get(w):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return length - row.bit_count()


def answered(where: dict[bytes, int], length: int, words: list[bytes]) -> float:
    """The largest share of an answer (its places and length) that stands in order in a window of ``words`` of twice its length."""
    size = max(2 * length, 32)
    return max((common(where, length, words[a : a + size]) / length for a in range(0, max(1, len(words) - size // 2), size // 2)), default=0.0)


def verbatim(short: list[tuple[int, list[bytes], list[bytes]]], count: dict[bytes, int]) -> dict[bytes, list[tuple[int, int]]]:
    """For the rarest word of each short passage the passages that it is looked up for, and its place in them."""
    out: dict[bytes, list[tuple[int, int]]] = {}
    for k, (_, words, _) in enumerate(short):
        at = min(range(len(words)), key=lambda i: (count[words[i]], i))
        out.setdefault(words[at], []).append((k, at))
    return out


def frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """In how many documents each word of ``vocabulary`` occurs, and the number of documents."""
    held, n = docs.sparkSession.sparkContext.broadcast(vocabulary), len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, get = np.zeros(n + 1, np.int64), 0, held.value.get
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                total += 1
                ids = {*map(get, {*words_of(text)})}
                ids.discard(None)
                count[np.fromiter(ids, np.int64, len(ids))] += 1
        count[n] = total
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(count)), pa.array(count[count > 0])], names=["word", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n")).collect()
    held.unpersist()
    count = np.zeros(n + 1, np.int64)
    for w, k in rows:  # one row for each word of the block
        count[w] = k
    return count[:n], int(count[n])


def latent(table: DataFrame, terms: int, rank: int, rounds: int = 2, seed: int = 11) -> np.ndarray:
    """The ``rank`` leading right singular vectors (terms x rank) of ``table`` (ids array<int>, weights array<double>), by randomised SVD."""
    context = table.sparkSession.sparkContext
    width = min(rank + 8, terms)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, width)))[0]
    for _ in range(rounds + 1):
        held = context.broadcast(basis)

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((terms, width))
            for pdf in parts:
                for ids, weights in zip(pdf["ids"], pdf["weights"], strict=True):
                    total[ids] += np.outer(weights, weights @ held.value[ids])
            full = np.flatnonzero(total.any(1))
            if len(full):  # a task may have no rows
                yield pd.DataFrame({"term": full, "sums": list(total[full])})

        parts = table.mapInPandas(run, "term long, sums array<double>")
        sums = parts.groupBy("term").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]).collect()
        image = np.zeros((terms, width))
        for t, *row in sums:  # one row for each word of the block
            image[t] = row
        small = basis.T @ image  # the Gram matrix of A in the basis
        basis = np.linalg.qr(image)[0]
        held.unpersist()
    _, turn = np.linalg.eigh((small + small.T) / 2)
    return (basis @ turn[:, ::-1])[:, :rank].astype(np.float32) if width > rank else basis.astype(np.float32)


def holders(lists: list[list[int]], at: np.ndarray, terms: int) -> np.ndarray:
    """For each of ``terms`` words 1 at the passages of ``at`` that count it."""
    out = np.zeros((terms, len(at)), np.uint8)
    for k, p in enumerate(at):
        out[lists[p], k] = 1
    return out


def by_step(table: np.ndarray, ids: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """For each of ``edge`` the sum of the rows of ``table`` that ``ids`` names from there to the next edge.

    A step has few words: the first words of all steps are taken together, then the second ones of those that have two, and so on.
    """
    n = np.diff(edge, append=len(ids))
    order = np.argsort(-n, kind="stable")
    first, n = edge[order], n[order]
    sums = table[ids[first]]
    for k in range(1, n[0]):
        more = np.searchsorted(-n, -k)  # so many have a word after their k-th
        sums[:more] += table[ids[first[:more] + k]]
    out = np.empty_like(sums)
    out[order] = sums
    return out


def halves(steps: np.ndarray, half: int) -> np.ndarray:
    """Sums of every ``half`` rows of ``steps``."""
    if half == 1:
        return steps
    out = steps[::half].copy()
    for k in range(1, half):
        out += steps[k::half]
    return out


def search(docs: DataFrame, block: list[tuple[int, list[bytes], list[bytes]]], rank: int = 64, near: float = 0.7, stop_share: float = 0.1, leaked: float = 0.8, paraphrase: float = 0.6) -> DataFrame:
    """Rows of ``FOUND`` for every document and every item of ``block`` that it leaks; the best passage of each pair."""
    spark = docs.sparkSession
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, p, _ in block for w in p}))}
    count, total = frequencies(docs, vocabulary)
    short = [p for p in block if len(p[1]) < LEAST]
    anchors = verbatim(short, {w: int(count[i]) for w, i in vocabulary.items()})
    block = [p for p in block if len(p[1]) >= LEAST]
    if not block:
        return docs.select(F.col("doc_id").cast("long"), text_key().alias("th"), F.col("text").cast("string")).mapInArrow(exact(short, anchors), FOUND)
    idf = np.log((1 + total) / (1 + count)) + 1e-3
    words = [[vocabulary[w] for w in part] for _, part, _ in block]
    rare = count <= stop_share * total
    kept = {i for ids in words for i in (ids if sum(rare[ids]) < 4 else [i for i in ids if rare[i]])}
    at = {i: n for n, i in enumerate(sorted(kept))}
    # the words of each passage that are counted: the rare ones, if a match needs some of them, or else all
    needs, counted = [], []
    for ids in words:
        least = math.ceil(paraphrase * len(ids) - 1e-9)
        need = least - int(len(ids) - sum(rare[ids]))
        counted.append({i for i in ids if rare[i]} if need > 0 else {*ids})
        needs.append(need if need > 0 else least)
    used = sorted(kept.union(*counted))
    row = {i: n for n, i in enumerate(used)}
    looked = {w: row[i] for w, i in vocabulary.items() if i in row}
    lists = [sorted(row[i] for i in ids) for ids in counted]
    idf = idf[sorted(kept)]
    rows = []
    for n, ids in enumerate(words):
        tf = Counter(at[i] for i in ids if i in at)
        weights = np.array([c * idf[i] for i, c in tf.items()])
        rows.append((n, list(tf), (weights / np.linalg.norm(weights)).tolist()))
    table = spark.createDataFrame(rows, "n int, ids array<int>, weights array<double>").repartition(8)
    axes = latent(table.select("ids", "weights"), len(kept), min(rank, len(block)))
    folded = np.array([np.asarray(w, np.float32) @ axes[ids] for _, ids, w in rows])
    folded /= np.linalg.norm(folded, axis=1, keepdims=True) + 1e-9
    token = np.zeros((len(used), axes.shape[1]), np.float32)
    token[[row[i] for i in sorted(kept)]] = axes * idf[:, None]
    held = spark.sparkContext.broadcast((looked, token, folded, block, lists, np.array(needs, np.uint8)))  # a passage has about a hundred words at most
    copies = exact(short, anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, token, folded, block, lists, needs = held.value
        lengths = np.array([len(p) for _, p, _ in block])
        places = [(positions(p), len(p), positions(a), len(a)) for _, p, a in block]
        # the distinct words of each passage, and how many of them no match can do without
        distinct = [frozenset(p) for _, p, _ in block]
        wanted = [math.ceil(paraphrase * len(p) - 1e-9) - (len(p) - len(own)) for (_, p, _), own in zip(block, distinct, strict=True)]
        # windows of so many steps, for passages of at most half their length
        sizes = [(k, np.flatnonzero((lengths > lo) & (lengths <= hi))) for k, lo, hi in ((2, 0, STEP), (4, STEP, 2 * STEP), (8, 2 * STEP, 4 * STEP), (MOST, 4 * STEP, 1 << 30))]
        sizes = [(k, at, folded[at].T.copy(), [holders(lists, at[c : c + WIDE], len(vocabulary)) for c in range(0, len(at), WIDE)]) for k, at in sizes if len(at)]
        get = vocabulary.get
        for batch in slices(batches, limit=1 << 20):
            yield from copies([batch])
            split = [words_of(t) for t in batch.column("text").to_pylist()]
            n = np.fromiter(map(len, split), np.int64, len(split))
            steps = -(-n // STEP)
            room = -(-steps // MOST) * MOST
            first = np.cumsum(room) - room  # a text's first step of STEP words among all steps of the batch
            ids = np.fromiter(map(get, chain.from_iterable(split), repeat(-1)), np.int64, n.sum())
            known = np.flatnonzero(ids >= 0)
            if not len(known):
                continue
            doc = np.repeat(np.arange(len(split)), n)[known]
            step = first[doc] + (known - (np.cumsum(n) - n)[doc]) // STEP
            edge = np.flatnonzero(np.diff(step, prepend=-1))
            filled, ids = step[edge], ids[known]
            owner = np.repeat(np.arange(len(split)), room)
            after = np.arange(len(owner)) - first[owner]  # a step's number in its text
            sums = np.zeros((len(owner) + MOST, token.shape[1]), np.float32)  # the last steps are empty
            sums[filled] = by_step(token, ids, edge)
            best: dict[tuple[int, int], tuple] = {}
            for size, at, items, tables in sizes:
                # how many words of each step a passage holds: at most STEP, and at most MOST * STEP in a window
                held_words = np.zeros((len(sums), len(at)), np.uint8)
                for c, holds in enumerate(tables):
                    held_words[filled, c * WIDE : (c + 1) * WIDE] = by_step(holds, ids, edge)
                half = size // 2
                half_sums, held_words, least = halves(sums, half), halves(held_words, half), needs[at]
                # windows start every half window; one that runs over a text's end is cut there
                begin = np.flatnonzero((after < steps[owner])[::half])
                follow = np.where((after + half < room[owner])[::half][begin], begin + 1, len(owner) // half)
                for c in range(0, len(begin), 2048):
                    s, t = begin[c : c + 2048], follow[c : c + 2048]
                    v = half_sums[s] + half_sums[t]
                    v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-9
                    cosine = v @ items
                    near_at, near_item = np.nonzero((cosine >= near) | (held_words[s] + held_words[t] >= least))
                    window = -1
                    for r, k in zip(near_at.tolist(), near_item.tolist(), strict=True):
                        if r != window:
                            window, start = r, int(s[r]) * half
                            d = int(owner[start])
                            from_word = int(after[start]) * STEP
                            region = split[d][from_word : from_word + size * STEP]
                            present = {*region}
                        p = int(at[k])
                        # a frequent word may stand in a window many times, but a match takes it no more often than the passage has it
                        if len(distinct[p] & present) < wanted[p]:
                            continue
                        where, length, told_where, told_length = places[p]
                        share = common(where, length, region) / length
                        if share < paraphrase:
                            continue
                        told = common(told_where, told_length, region) / told_length
                        if share < leaked and told < 0.8:
                            told = answered(told_where, told_length, split[d])
                        if share >= leaked or told >= 0.8:
                            best[d, p] = max(best.get((d, p), (0.0, 0.0, 0.0)), (share, float(cosine[r, k]), told))
            if best:
                keys = sorted(best)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(pa.array([d for d, _ in keys])) for c in ("doc_id", "th")] + [pa.array([block[p][0] for _, p in keys], pa.int64())]
                    + [pa.array([best[k][i] for k in keys], pa.float64()) for i in (1, 0, 2)],
                    names=["doc_id", "th", "item_id", "cosine", "lcs", "answer_lcs"],
                )

    return docs.select(F.col("doc_id").cast("long"), text_key().alias("th"), F.col("text").cast("string")).mapInArrow(run, FOUND)


def exact(short: list[tuple[int, list[bytes], list[bytes]]], anchors: dict[bytes, list[tuple[int, int]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Finds short passages word for word; what it holds is bounded by the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = [(positions(a), len(a)) for _, _, a in short]
        for batch in batches if short else ():
            rows: list[tuple] = []
            for d, text in enumerate(batch.column("text").to_pylist()):
                words, seen = words_of(text), set()
                for p, w in enumerate(words):
                    for k, at in anchors.get(w, ()):
                        item, own, _ = short[k]
                        if k not in seen and p >= at and words[p - at : p - at + len(own)] == own:
                            seen.add(k)
                            share = answered(*told[k], words)
                            if share >= 0.8:
                                rows.append((d, item, share))
            if rows:
                at = pa.array([d for d, _, _ in rows])
                ones = pa.array([1.0] * len(rows), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("th").take(at), pa.array([i for _, i, _ in rows], pa.int64()), ones, ones, pa.array([s for _, _, s in rows], pa.float64())],
                    names=["doc_id", "th", "item_id", "cosine", "lcs", "answer_lcs"],
                )

    return run


def blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, list[bytes], list[bytes]]]]:
    """The benchmark's passages, at most ``block_words`` words at a time; rows come to the driver partition by partition."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"), answer).toLocalIterator():
        for p in passages([tuple(row)]):
            if held and size + len(p[1]) > block_words:
                yield held
                held, size = [], 0
            held.append(p)
            size += len(p[1])
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame, block_words: int = 32_768, **how: float) -> DataFrame:
    """One row per document and benchmark item that it leaks, with the best passage's cosine and shares in order."""
    found = docs.sparkSession.createDataFrame([], FOUND)
    for block in blocks(benchmark, block_words):
        found = found.union(search(docs, block, **how))
    best = F.max(F.struct("lcs", "cosine", "answer_lcs")).alias("best")
    return found.groupBy("doc_id", "th", "item_id").agg(best).select("doc_id", "th", "item_id", "best.cosine", "best.lcs", "best.answer_lcs")
