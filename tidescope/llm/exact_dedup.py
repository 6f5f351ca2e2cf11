"""Exact deduplication as a stateful stream over content digests.

A streaming aggregation keyed by digest keeps its state in RocksDB, without a watermark: no key ever expires.
Per digest the state retains the stable identifier of the row that stays (the largest doc_id), the locator of
its content (the input file) and the number of rows seen. Every digest with a hit is then checked on full bytes: its rows'
texts, each found by the digest that it has itself, must all be the same bytes from the smallest to the
largest. Digests whose rows differ fall apart into one group for each text. A folder can be given again with more
rows: the state goes on, and a hit on an earlier row is checked against the text that its locator leads to.

Texts are large and hits are few, so only texts that may be hits are moved: a map of at most 2**20 words of 64 bits, one bit for each
hit's digest, goes to every task and lets all hits through. What it lets through beside them is dropped by the join.

A digest that a thousandth of all rows share is joined by broadcast (fewer than a thousand digests can be like that), any
other by a shuffle.

Only DataFrame functions: no Python runs on executors.

Defined cases: a null text counts as empty; empty texts are equal to each other; a null doc_id ranks below every
other; rows that repeat a doc_id are rows of their own, each in the group of its text, and where they repeat the text too
both are rows of the group and :func:`keep` leaves one of them. An empty table gives an empty result. Extra columns
pass through :func:`keep` untouched, whatever their names.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescope.llm.common import cut, drop_table, join_hot, path_exists, shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State on disk; many small stores must not each set space aside beforehand, and those of an executor share one bound of memory.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
#: Bits of the map of hits.
MAP_BITS = 1 << 26


def normalised(text: Column) -> Column:
    """A-Z become a-z, nothing else changes; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digests(docs: DataFrame, hex_digits: int = 64) -> DataFrame:
    """(doc_id, text_sha256, digest, locator) per row. ``hex_digits`` under 64 shortens the key, to test hits that differ."""
    sha = F.sha2(normalised(F.col("text")), 256)
    return docs.select("doc_id", sha.alias("text_sha256"), F.input_file_name().alias("locator")).withColumn(
        "digest", F.substring("text_sha256", 1, hex_digits)
    )


def retain(spark: SparkSession, source: str, schema, state: str, files_per_trigger: int = 64) -> DataFrame:
    """Run the stateful stream over the digest rows in ``source`` up to now; (digest, keep_id, locator, group_size).

    ``state`` holds the stream's checkpoint and what each micro-batch changed; a later call with the same folder
    goes on from there, reading new files alone.
    """
    own = spark.newSession()  # with settings of its own: other queries keep theirs
    for k, v in SETTINGS.items():
        own.conf.set(k, v)
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(k, spark.conf.get(k))
    changed = f"{state}/changed"

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changed}/batch={number}")  # a replayed batch overwrites itself

    rows = (
        own.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "locator")).alias("retained"), F.count("*").alias("group_size"))
    )
    query = (
        rows.writeStream.outputMode("update").option("checkpointLocation", f"{state}/checkpoint")
        .trigger(availableNow=True).foreachBatch(store).start()
    )
    query.awaitTermination()
    kinds = "digest string, retained struct<doc_id:bigint,locator:string>, group_size bigint, batch int"
    changes = spark.read.schema(kinds).parquet(changed) if path_exists(spark, changed) else spark.createDataFrame([], kinds)
    # both only ever grow, so the largest is the last
    return changes.groupBy("digest").agg(F.max("retained").alias("r"), F.max("group_size").alias("group_size")).select(
        "digest", F.col("r.doc_id").alias("keep_id"), F.col("r.locator").alias("locator"), "group_size"
    )


def dedup(docs: DataFrame, hex_digits: int = 64, files_per_trigger: int = 64, folder: str | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, digest, locator (of the row that stays).

    ``folder``: where digests and state stay for further calls; each call then brings the rows that are new as ``docs`` and as
    ``corpus`` a table in which the rows of earlier calls can be read.
    """
    spark = docs.sparkSession
    base = folder or shared_dir(spark)
    slim = cut(digests(docs, hex_digits), f"{base}/digests/{uuid.uuid4().hex}")
    kept = cut(retain(spark, f"{base}/digests/*", slim.schema, f"{base}/state", files_per_trigger), f"{base}/retained/{uuid.uuid4().hex}")
    total = slim.count()
    wrong = mismatched(docs, corpus, kept, total, hex_digits)
    names = ["doc_id", "keep_id", "group_size", "text_sha256", "digest", "locator"]
    found = join_hot(slim.drop("locator"), kept, ["digest"], "group_size", total).select(*names)
    if not wrong.isEmpty():
        found = found.join(wrong, "digest", "left_anti").select(*names).union(apart(docs, corpus, wrong, hex_digits).select(*names))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def texts(docs: DataFrame, hex_digits: int) -> DataFrame:
    """(digest, doc_id, text, locator) of every row, the text normalised and the digest its own."""
    text = normalised(F.col("text"))
    return docs.select(F.substring(F.sha2(text, 256), 1, hex_digits).alias("digest"), "doc_id", text.alias("text"), F.input_file_name().alias("locator"))


def marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` and whether one of ``keys`` may have their digest (both: digest): always where one has, rarely elsewhere.

    The map that is broadcast has at most ``MAP_BITS / 64`` rows of two numbers, however many keys there are.
    """
    slot = F.pmod(F.xxhash64("digest"), F.lit(MAP_BITS))
    at = keys.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(digest), {MAP_BITS}) & 63 as int))").alias("bit"))
    bits = F.broadcast(at.groupBy("word").agg(F.bit_or("bit").alias("bits")))
    may = F.coalesce(F.getbit("bits", F.col("slot").bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
    names = rows.columns
    return rows.withColumn("slot", slot).withColumn("word", F.shiftright("slot", 6)).join(bits, "word", "left").select(*names, may.alias("may"))


def mismatched(docs: DataFrame, corpus: DataFrame | None, kept: DataFrame, total: int, hex_digits: int) -> DataFrame:
    """(digest) of every digest with hits whose rows have different bytes; none unless digests collide.

    Texts of hits alone are compared, in full; a group's smallest and largest text meet after each task has found its own.
    """
    hits = kept.filter("group_size > 1").select("digest", "group_size", "keep_id", "locator")
    rows = marked(texts(docs, hex_digits).select("digest", "text"), hits).filter("may").drop("may")
    found = join_hot(rows, hits.select("digest", "group_size"), ["digest"], "group_size", total).select("digest", "text")
    if corpus is not None:
        earlier = marked(texts(corpus, hex_digits), hits).filter("may").drop("may").join(hits.withColumnRenamed("keep_id", "id"), ["digest", "locator"]).filter(F.col("doc_id").eqNullSafe(F.col("id")))
        found = found.union(earlier.select("digest", "text"))
    ends = found.groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    return cut(ends.filter("low <> high").select("digest"))


def apart(docs: DataFrame, corpus: DataFrame | None, wrong: DataFrame, hex_digits: int) -> DataFrame:
    """The rows of ``docs`` under digests that collide, in groups of equal texts."""
    rows = texts(docs, hex_digits).join(wrong, "digest", "left_semi")
    every = rows if corpus is None else texts(corpus, hex_digits).join(wrong, "digest", "left_semi")
    groups = every.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    met = rows.join(groups, ["digest", "text"])
    return met.select("doc_id", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256"), "digest", F.lit(None).cast("string").alias("locator"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns of ``docs``: of equal texts the one with the largest doc_id."""
    spark = docs.sparkSession
    base = shared_dir(spark)
    several = cut(dedup(docs, folder=base).filter("group_size > 1").select("doc_id", "kept", F.col("text_sha256").alias("digest")))
    drop_table(spark, base)
    out = several.groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    out = out.select(F.col("doc_id").alias("out_id"), F.col("digest").alias("out_digest"), "kept", "n")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.sha2(normalised(F.col("text")), 256).alias("digest"))
    rows = marked(rows, several)
    # a row whose text has no copy stays where it is; of the others the state decides
    met = rows.filter("may").join(out, F.col("id").eqNullSafe(F.col("out_id")) & (F.col("digest") == F.col("out_digest")), "left")
    once = rows.filter("not may").select("row").union(met.filter("n is null or kept and n = 1").select("row"))
    again = met.filter("kept and n > 1").groupBy("id", "digest").agg(F.first("row").alias("row")).select("row")
    return once.union(again).select("row.*")
