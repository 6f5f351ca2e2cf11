"""What the operators of this subpackage share: the cluster's shared folder, row packing and components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescope.functions.storage import cut, shared_dir


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table that :func:`cut` wrote and nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


#: Where the public tokenizer's model lies on every machine, unless the caller names another.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_key() -> Column:
    """With the doc_id, what tells rows apart: a hash of the text."""
    return F.xxhash64(F.col("text").cast("string"))


def keep_rows(docs: DataFrame, decisions: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` that ``decisions`` (doc_id, th) names (``left_semi``) or doesn't (``left_anti``).

    A row is named by its doc_id and its text together, so rows that repeat a doc_id fare each by its own text, and a null
    doc_id counts like any other. Extra columns of either side can't clash.
    """
    named = decisions.select(F.col("doc_id").cast("long").alias("id"), F.col("th").alias("h"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc"), text_key().alias("th"))
    return rows.join(named, F.col("doc").eqNullSafe(F.col("id")) & (F.col("th") == F.col("h")), how).select("row.*")


def join_hot(rows: DataFrame, keyed: DataFrame, key: list[str], count: str, total: int) -> DataFrame:
    """``rows`` joined with ``keyed`` (one row for each key; ``count``: how many of the ``total`` rows have it).

    Keys of more than a thousandth of all rows, which are fewer than a thousand, are broadcast, so that no task gets a hot
    key whole; the others meet in an ordinary join.
    """
    hot = F.col(count) > total / 1000
    often = F.broadcast(keyed.filter(hot))
    rest = rows.join(F.broadcast(keyed.filter(hot).select(*key)), key, "left_anti")
    return rows.join(often, key).unionByName(rest.join(keyed.filter(~hot), key))


#: Bits of the filter of :func:`likely`: 4 MB.
BITS = 1 << 25


def likely(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` (long) isn't among ``keys``; a join of the two that follows moves few others.

    The hash of each key sets one bit. The bitmaps, of 4 KB each, are broadcast: 4 MB in all, however many keys there are. No row whose key is
    there is lost; of the others the share of set bits stays.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(BITS)) + 1
    part, at = F.bitmap_bucket_number(slot).alias("part"), F.bitmap_bit_position(slot).alias("at")
    held = keys.filter(F.col(key).isNotNull()).select(part, at).repartition("part")  # one bitmap has one writer
    held = F.broadcast(held.groupBy("part").agg(F.bitmap_construct_agg("at").alias("bitmap")))
    byte = "cast(conv(hex(substring(bitmap, cast(at div 8 as int) + 1, 1)), 16, 10) as int)"
    marked = rows.select(F.struct("*").alias("row"), part, at).join(held, "part")
    return marked.filter(f"shiftright({byte}, cast(at % 8 as int)) & 1 = 1").select("row.*")


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Meanwhile the shuffle files of a query go when it ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: What a worker remembers from task to task, by operator; a task of another operator drops it.
remembered: dict[str, dict] = {}


def give_back(owner: str | None = None) -> None:
    """Drop what other operators than ``owner`` left in this worker, and hand free memory to the system."""
    for name in remembered.keys() - {owner}:
        remembered[name].clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20, owner: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one holds about ``limit`` bytes of ``column``, or a single row.

    ``owner``: the operator whose memory (``remembered``) stays in the worker.
    """
    give_back(owner)
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
    give_back(owner)  # an idle worker holds nothing of its last batches


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) as (node, component): the smallest node of each.

    Alternates large-star and small-star steps until nothing changes. Each step is two aggregations and joins on node ids, written
    to the shared folder, where it takes the place of the one before; a node with very many neighbours is pre-aggregated for its
    minimum, and its rows meet that minimum in a join that adaptive execution splits. Self-loops are ignored; nodes without
    an edge don't appear.
    """
    spark = edges.sparkSession
    path, seen = shared_dir(spark), None
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), path)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        before, path = path, shared_dir(spark)
        now = cut(small.filter("u <> v").distinct(), path)
        drop_table(spark, before)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
