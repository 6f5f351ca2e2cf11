"""Sharding by histogram sort: near-equal bytes, equal texts side by side, one exchange.

Rows are ordered by (XXH64 of the text, XXH64 of the doc_id). Splitters between shards are found without moving a text: each
round counts the exact bytes and rows below candidate boundaries in every partition, sums them, and probes anew
only between the two candidates that enclose a target, until every boundary meets its tolerance or no key lies
between. What the driver holds is the splitters and their probes: ``PER_TARGET`` a splitter, ``PER_ROUND`` in all where there are
very many shards, which takes more rounds then.

Rows are exchanged once, by range of (shard, key) into partitions of about ``part_bytes``, so that no task holds a whole shard and a
text in a third of all rows is split by its doc_ids. They are numbered where they land and stored; a slot is the count of the shard's rows in
the partitions before plus the row's place in its own.

Probes start at the first key of a text hash, so a group of equal texts is split only where it straddles a boundary
and no boundary within the tolerance spares it; then it is split by doc_id, however hot it is.

Defined cases: a null text has size 1 and hashes like no other text but null; a null doc_id hashes like no other but null;
rows that repeat text and doc_id go to the same shard; an empty table gives an empty result. Extra columns
travel with their row, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidescope.llm.common import cut, drop_table, shared_dir

BIAS = 1 << 63
PER_TARGET, PER_ROUND = 128, 1 << 18


def keyed(docs: DataFrame) -> DataFrame:
    """(row: all columns, h, id, size): the order's key (id: the doc_id's hash), and UTF-8 bytes of the text plus 1."""
    text = F.col("text")
    return docs.select(
        F.struct("*").alias("row"), F.xxhash64(text).alias("h"), F.xxhash64(F.col("doc_id").cast("long")).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
    )


def packed(h: np.ndarray, i: np.ndarray) -> np.ndarray:
    """128-bit keys in order, as 16 big-endian bytes each."""
    both = np.empty((len(h), 2), ">u8")
    both[:, 0] = h.astype(np.int64).view(np.uint64) ^ np.uint64(BIAS)
    both[:, 1] = i.astype(np.int64).view(np.uint64) ^ np.uint64(BIAS)
    return both.reshape(-1).view("S16")


def to_bytes(keys: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(k.to_bytes(16, "big") for k in keys), "S16")


def from_bytes(key: bytes) -> int:
    return int.from_bytes(bytes(key).ljust(16, b"\0"), "big")


def histogram(keys: DataFrame, probes: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Per non-empty cell between sorted ``probes``: (cell, bytes, rows, smallest key, largest key). At most len(probes) + 1 rows."""
    bounds = keys.sparkSession.sparkContext.broadcast(to_bytes(probes))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = len(bounds.value) + 1
        size, rows, low, high = np.zeros(n, np.int64), np.zeros(n, np.int64), [b"\xff" * 17] * n, [b""] * n
        for pdf in batches:
            key = packed(pdf["h"].to_numpy(), pdf["id"].to_numpy())
            order = np.argsort(key)
            key, weight = key[order], pdf["size"].to_numpy()[order]
            cell = np.searchsorted(bounds.value, key, side="right")
            size += np.bincount(cell, weight, n).astype(np.int64)
            rows += np.bincount(cell, minlength=n)
            for c in np.unique(cell).tolist():
                a, b = np.searchsorted(cell, [c, c + 1])
                low[c], high[c] = min(low[c], bytes(key[a]).ljust(16, b"\0")), max(high[c], bytes(key[b - 1]).ljust(16, b"\0"))
        full = np.flatnonzero(rows)
        yield pd.DataFrame({"cell": full, "bytes": size[full], "rows": rows[full], "low": [low[c] for c in full], "high": [high[c] for c in full]})

    parts = keys.select("h", "id", "size").mapInPandas(count, "cell long, bytes long, rows long, low binary, high binary")
    found = parts.groupBy("cell").agg(F.sum("bytes"), F.sum("rows"), F.min("low"), F.max("high")).collect()
    return sorted((c, b, n, from_bytes(lo), from_bytes(hi)) for c, b, n, lo, hi in found)


def splitters(keys: DataFrame, targets: list[tuple[float, float]]) -> tuple[list[int], list[int], list[int], int]:
    """For sorted ``targets`` (fraction of all bytes, tolerance as a fraction): keys, the bytes and the rows below each, and all rows."""
    cells = histogram(keys, [])
    if not cells:
        return [0] * len(targets), [0] * len(targets), [0] * len(targets), 0
    (_, total, count, low, high), n = cells[0], len(targets)
    goal, slack = [f * total for f, _ in targets], [t * total for _, t in targets]
    # an interval: keys from lo (with the bytes and rows below it) to hi (likewise)
    state = [[low, 0, 0, high + 1, total, count] for _ in targets]
    while True:
        open_ = [i for i in range(n) if min(abs(state[i][1] - goal[i]), abs(state[i][4] - goal[i])) > slack[i] and state[i][3] - state[i][0] > 1]
        probes, each = set(), max(4, min(PER_TARGET, PER_ROUND // max(1, len(open_))))
        for lo, hi in {(state[i][0], state[i][3]) for i in open_}:
            whole = (hi >> 64) - (lo >> 64) > 1
            for j in range(1, each):
                p = lo + (hi - lo) * j // each
                p = (p >> 64 << 64) if whole else p
                if lo < p < hi:
                    probes.add(p)
            probes.add((lo >> 64) + 1 << 64 if whole else lo + 1)
        if not probes:
            break
        line = sorted(probes | {s[k] for i in open_ for s in [state[i]] for k in (0, 3)})
        cells = {c: rest for c, *rest in histogram(keys, line)}
        below = [(0, 0)]
        for c in range(len(line) + 1):
            b, r, *_ = cells.get(c, (0, 0))
            below.append((below[-1][0] + b, below[-1][1] + r))
        for i in open_:
            lo, _, _, hi, *_ = state[i]
            at = range(bisect_left(line, lo), bisect_right(line, hi))
            a = max(j for j in at if below[j + 1][0] <= goal[i] or line[j] == lo)
            b = min((j for j in at if j > a), default=a)
            left, right = line[a], line[b]
            state[i] = [left, *below[a + 1], right, *below[b + 1]]
            if a + 1 == b and (cell := cells.get(b)):  # what the cell holds bounds the next probes
                first, last = cell[2], cell[3]
                state[i][0] = max(left, first)
                if last + 1 < right:
                    state[i][3] = last + 1
    near = [s[:3] if abs(s[1] - g) <= abs(s[4] - g) else s[3:] for s, g in zip(state, goal, strict=True)]
    return [k for k, _, _ in near], [b for _, b, _ in near], [r for _, _, r in near], count


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.002, part_bytes: int = 64 << 20) -> DataFrame:
    """(row: the columns of ``docs``, shard int, slot long) with shards of equal bytes within ``tolerance`` of a shard."""
    spark = docs.sparkSession
    rows = keyed(docs)
    keys_at = shared_dir(spark)
    keys = cut(rows.select("h", "id", "size"), keys_at)
    total = keys.agg(F.sum("size")).first()[0] or 0
    edge = spark.sparkContext.broadcast(to_bytes(sorted(splitters(keys, [(i / shards, tolerance / shards) for i in range(1, shards)])[0])))
    drop_table(spark, keys_at)

    @F.pandas_udf(T.IntegerType())
    def place(h: pd.Series, i: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edge.value, packed(h.to_numpy(), i.to_numpy()), side="right").astype(np.int32))

    order = ["shard", "h", "id"]
    parts = max(shards, -(-total // part_bytes))
    dealt = rows.select("row", "h", "id", place("h", "id").alias("shard")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # a number holds the partition in its upper bits and the row's place there in its lower ones
    stored = cut(dealt.select("row", "shard", F.monotonically_increasing_id().alias("number")))
    part = F.shiftright("number", 33).alias("part")
    counts = stored.groupBy("shard", part).agg(F.count("*").alias("n"), F.min("number").alias("first"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    starts = counts.select("shard", "part", (before - F.col("first")).alias("shift"))
    if parts + shards <= 1 << 21:  # a partition holds an unbroken range: no more rows than that, of three numbers
        starts = F.broadcast(starts)
    return stored.withColumn("part", part).join(starts, ["shard", "part"]).select("row", "shard", (F.col("number") + F.col("shift")).cast("long").alias("slot"))
