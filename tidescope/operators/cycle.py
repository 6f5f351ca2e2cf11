"""A client's sync cycle: push what is queued, pull until nothing is left, then rebuild what must be."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidescope.functions.storage import cut
from tidescope.operators import client

PUSH_BATCH, ATTEMPTS = 100, 5


@dataclass(frozen=True)
class Copy:
    """What a client holds: rows, provenance, scopes and pending (see :mod:`tidescope.operators.client`), and rejections."""

    rows: DataFrame
    provenance: DataFrame
    scopes: DataFrame
    pending: DataFrame
    rejected: DataFrame | None = None

    def stored(self) -> Copy:
        """The same from stored tables, so that a long run of cycles has no long plan."""
        return replace(self, rows=cut(self.rows), provenance=cut(self.provenance), scopes=cut(self.scopes), pending=cut(self.pending), rejected=self.rejected and cut(self.rejected))


@dataclass(frozen=True)
class Page:
    """A pull's answer: changes (scope_id, table_name, record_id, seq, op, row_json, version, checksum), cursors (scope_id, cursor), on the last page server
    checksums (scope_id, checksum), the scopes to rebuild, and the scopes that come and go."""

    changes: DataFrame
    cursors: DataFrame
    checksums: DataFrame
    rebuild: list[str]
    has_more: bool
    add: tuple[str, ...] = ()
    remove: tuple[str, ...] = ()


def run(
    copy: Copy, push: Callable[[DataFrame], DataFrame], pull: Callable[[DataFrame], Page], rebuild: Callable[[str, str | None], dict],
) -> tuple[Copy, Counter]:
    """(copy, requests by kind) after one cycle.

    ``push`` takes mutations, at most 100, and gives results (mutation_id, table_name, record_id, status, code, row_json, version). ``pull`` takes the scopes with their
    cursors. ``rebuild`` takes a scope and a page cursor and gives records, has_more, cursor and, at the end, checkpoint and checksum. Rejections that may
    be retried stay queued for up to five attempts.
    """
    requests: Counter = Counter()
    attempt = 0
    while not copy.pending.isEmpty():
        batch = copy.pending.orderBy("client_version", "table_name", "record_id").limit(PUSH_BATCH)
        results = cut(push(client.mutations(batch, copy.rows)))
        requests["push"] += 1
        left, rejected = client.settle(copy.pending, results)
        gone = client.mutations(batch, copy.rows).select("table_name", "record_id")
        lost = batch.filter("operation <> 'delete'").select("table_name", "record_id").join(gone, ["table_name", "record_id"], "left_anti")  # its row is gone: nothing to push
        left = left.join(lost, ["table_name", "record_id"], "left_anti").select(*copy.pending.columns)
        copy = replace(copy, rows=client.canonical(copy.rows, results), pending=left, rejected=rejected if copy.rejected is None else copy.rejected.unionByName(rejected)).stored()
        attempt += 1
        if not results.filter("status = 'rejected_retryable'").isEmpty() and not client.retries(results, attempt, ATTEMPTS):
            break
    asked: list[str] = []
    while True:
        page = pull(copy.scopes)
        requests["pull"] += 1
        rows, provenance = client.apply_changes(copy.rows, copy.provenance, copy.scopes, page.changes)
        scopes = client.end_page(copy.scopes, page.cursors, page.checksums, provenance)
        scopes, rows, provenance = client.apply_scope_delta(scopes, rows, provenance, list(page.add), list(page.remove))
        copy = replace(copy, rows=rows, provenance=provenance, scopes=scopes).stored()
        asked += page.rebuild
        if not page.has_more:
            break
    spark = copy.scopes.sparkSession
    due = client.to_rebuild(copy.scopes, spark.createDataFrame([(s,) for s in asked], "scope_id string"))
    for scope in sorted(r["scope_id"] for r in due.collect()):  # a client's own scopes
        copy, pages = rebuilt(copy, scope, rebuild)
        requests["rebuild"] += pages
    return copy, requests


def rebuilt(copy: Copy, scope: str, rebuild: Callable[[str, str | None], dict]) -> tuple[Copy, int]:
    """(copy, pages) after a scope was read anew, page by page; a checksum that differs from the server's is an error."""
    spark = copy.scopes.sparkSession
    copy = replace(copy, scopes=client.begin_rebuild(copy.scopes, [scope]))
    cursor, pages = None, 0
    kinds = "scope_id string, table_name string, record_id string, seq long, op string, row_json string, version string, checksum long"
    while True:
        page = rebuild(scope, cursor)
        pages += 1
        records = [(scope, r["table_name"], r["record_id"], i, "upsert", r["row_json"], r["row_version"], r["checksum"]) for i, r in enumerate(page["records"])]
        changes = spark.createDataFrame(records, kinds).withColumn("version", F.col("version").cast(copy.rows.schema["version"].dataType)).withColumn("checksum", F.col("checksum").cast(copy.provenance.schema["checksum"].dataType))
        rows, provenance = client.apply_changes(copy.rows, copy.provenance, copy.scopes, changes)
        copy = replace(copy, rows=rows, provenance=provenance).stored()
        if not page["has_more"]:
            break
        cursor = page["cursor"]
    rows, provenance, scopes = client.finish_rebuild(copy.rows, copy.provenance, copy.scopes, scope, str(page["checkpoint"]), page["checksum"])
    return replace(copy, rows=rows, provenance=provenance, scopes=scopes).stored(), pages
