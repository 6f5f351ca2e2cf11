"""The change stream: decoded row changes in, change log and quarantine out, exactly once per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidescope.operators.scopes import apply_events, diff_entries


def decode(changes: DataFrame) -> DataFrame:
    """(table_name, record_id, operation, error) from raw changes (kind I/U/D, table_name, record_id, deleted_at).

    An update that leaves deleted_at set is a delete; an insert stays an insert; other kinds are ignored; a row without its
    key is an error.
    """
    op = F.when(F.col("kind") == "I", 1).when((F.col("kind") == "U") & F.col("deleted_at").isNotNull(), 3).when(F.col("kind") == "U", 2).when(F.col("kind") == "D", 3)
    wrong = F.when(F.coalesce("record_id", F.lit("")) == "", "record without a primary key")
    return changes.withColumn("operation", op.cast("int")).filter("operation is not null").withColumn("error", wrong)


def consume(
    changes: DataFrame, apply: Callable[[DataFrame, int], DataFrame], log: str, quarantine: str, checkpoint: str, once: bool = True,
    registered: Callable[[], DataFrame] | None = None,
) -> StreamingQuery:
    """Run ``apply(events, batch_id)`` on every micro-batch and write its entries; failed rows go to ``quarantine`` with their error.

    ``registered`` gives the synced tables (table_name) and is asked anew for every batch; changes to other tables are left out. Both sinks are folders by batch
    id that a replayed batch overwrites: peek, apply, commit, advance. How much a batch holds is the source's setting (``maxFilesPerTrigger``).
    """

    def step(batch: DataFrame, number: int) -> None:
        some = batch if registered is None else batch.join(F.broadcast(registered().select("table_name").distinct()), "table_name", "left_semi").select(*batch.columns)
        decoded = decode(some)
        decoded.filter("error is not null").write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        apply(decoded.filter("error is null").drop("error"), number).write.mode("overwrite").parquet(f"{log}/batch={number}")

    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="100 milliseconds")).start()


def materialise(edges: str, desired: Callable[[DataFrame], DataFrame], spark: SparkSession) -> Callable[[DataFrame, int], DataFrame]:
    """An ``apply`` for :func:`consume` that keeps the edges under the folder ``edges`` up to date and gives the batch's change-log entries.

    ``desired``: the edges, with checksums, of the records of a batch's events as the base tables are now. The state after batch n is stored as
    ``edges/n`` (``edges/-1``: before the first), so a replayed batch starts from what it started from before. Events of one record need their order in ``position``.
    """

    def apply(events: DataFrame, number: int) -> DataFrame:
        now = spark.read.parquet(f"{edges}/{number - 1}")
        records = events.select("table_name", "record_id").distinct()
        own = now.join(records, ["table_name", "record_id"], "left_semi")
        wanted = desired(events).select(*now.columns)
        entries = diff_entries(events, own, wanted)
        apply_events(now, events, wanted).write.mode("overwrite").parquet(f"{edges}/{number}")
        return entries

    return apply
