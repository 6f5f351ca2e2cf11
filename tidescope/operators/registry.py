"""Which tables are synced: registrations and their checks, scope SQL, shared scopes, and changes of the schema."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescope.functions.canonical import row_json, signed_crc32
from tidescope.functions.types import of_spark
from tidescope.operators.scopes import edges, resolved

POLICIES = ("enabled", "read_only")


def synced_columns(actual: list[str], chosen: Iterable[str] = (), excluded: Iterable[str] = (), needed: Iterable[str] = ()) -> list[str]:
    """The columns that clients see, in table order: the chosen ones, or all but the excluded; ``needed`` ones can't be left out."""
    chosen, excluded = list(chosen), list(excluded)
    if chosen and excluded:
        raise ValueError("give the synced columns or the excluded ones, not both")
    given = chosen or excluded
    if len(set(given)) < len(given):
        raise ValueError(f"a column is given twice: {given}")
    if unknown := [c for c in given if c not in actual]:
        raise ValueError(f"no such columns: {unknown}")
    kept = [c for c in actual if (c in chosen if chosen else c not in excluded)]
    if missing := [c for c in needed if c not in kept]:
        raise ValueError(f"must be synced: {missing}")
    return kept


@dataclass(frozen=True)
class Table:
    """A synced table. ``scope_sql`` gives (record_id, scope_id) or (record_id, scopes array) for all rows at once."""

    name: str
    scope_sql: str
    pk: str
    columns: tuple[str, ...]
    updated_at: str | None
    deleted_at: str | None
    push_policy: str = "enabled"


@dataclass
class Registry:
    """Registrations by table, and shared scopes (id: portable) that every client gets."""

    spark: SparkSession
    tables: dict[str, Table] = field(default_factory=dict)
    shared: dict[str, bool] = field(default_factory=dict)

    def register(
        self, name: str, scope_sql: str, pk: str = "id", updated_at: str = "updated_at", deleted_at: str = "deleted_at",
        push_policy: str = "enabled", exclude: Iterable[str] = (), columns: Iterable[str] = (),
    ) -> Table:
        """Register the view or table ``name``, or replace its registration. The scope SQL is analysed, not run."""
        if push_policy not in POLICIES:
            raise ValueError(f"push policy must be one of {POLICIES}")
        actual = self.spark.table(name).columns
        if pk not in actual:
            raise ValueError(f"no key column {pk} in {name}")
        times = [c if c in actual else None for c in (updated_at, deleted_at)]
        kept = synced_columns(actual, columns, exclude, [pk, *filter(None, times)])
        given = self.spark.sql(scope_sql).columns
        if "record_id" not in given or not {"scope_id", "scopes"} & set(given):
            raise ValueError("scope SQL must give record_id and scope_id or scopes")
        self.tables[name] = table = Table(name, scope_sql, pk, tuple(kept), *times, push_policy)
        return table

    def unregister(self, name: str, current: DataFrame) -> DataFrame:
        """Forget a table; ``current`` edges without its own. The change log stays."""
        del self.tables[name]
        return current.filter(F.col("table_name") != name)

    def share(self, scope_id: str, portable: bool = False) -> None:
        if not scope_id.strip() or scope_id.strip().startswith("user:"):
            raise ValueError("a shared scope needs a name that no user's scope can have")
        self.shared[scope_id] = portable

    def unshare(self, scope_id: str) -> None:
        self.shared.pop(scope_id, None)

    def live(self, name: str) -> DataFrame:
        t = self.tables[name]
        rows = self.spark.table(name)
        return rows.filter(F.col(t.deleted_at).isNull()) if t.deleted_at else rows

    def members(self, name: str) -> DataFrame:
        """(record_id, scope_id) from the table's scope SQL, for all its records."""
        found = self.spark.sql(self.tables[name].scope_sql)
        return resolved(found.select("record_id", F.explode("scopes").alias("scope_id")) if "scopes" in found.columns else found.select("record_id", "scope_id"))

    def backfill(self, names: Iterable[str] | None = None) -> DataFrame:
        """Edges of all live rows of the given tables (all, if none are given), computed anew; no change-log entries."""
        parts = []
        for name in names or sorted(self.tables):
            t = self.tables[name]
            sums = self.live(name).select(F.col(t.pk).cast("string").alias("record_id"), signed_crc32(row_json(list(t.columns))).alias("checksum"))
            alive = self.members(name).join(sums.select("record_id"), "record_id", "left_semi")
            parts.append(edges(name, alive, sums))
        return reduce(DataFrame.union, parts)

    def live_ids(self, name: str) -> DataFrame:
        """(record_id) of the table's live rows in order of the key."""
        pk = self.tables[name].pk
        return self.live(name).orderBy(pk).select(F.col(pk).cast("string").alias("record_id"))

    def counters(self, names: Iterable[str] | None = None) -> DataFrame:
        """One row about a backfill of the given tables: tables, records and edges."""
        made = self.backfill(names)
        return made.agg(F.countDistinct("table_name").alias("tables"), F.countDistinct("table_name", "record_id").alias("records"), F.count("*").alias("edges"))

    def listing(self) -> DataFrame:
        """A row for each synced table by name: key, times, push policy and synced columns."""
        kinds = "table_name string, pk string, updated_at string, deleted_at string, push_policy string, columns array<string>"
        return self.spark.createDataFrame([(t.name, t.pk, t.updated_at, t.deleted_at, t.push_policy, list(t.columns)) for _, t in sorted(self.tables.items())], kinds)

    def indexes(self, given: DataFrame) -> DataFrame:
        """Of ``given`` indexes (table_name, index_name, columns, is_primary) those that clients get: not primary, and on synced columns alone."""
        own = self.listing().select("table_name", F.col("columns").alias("_synced"))
        met = given.join(own, "table_name").filter(~F.col("is_primary") & (F.size(F.array_except("columns", "_synced")) == 0))
        return met.select("table_name", "index_name", "columns").orderBy("table_name", "index_name")

    def required_on_insert(self, name: str) -> list[str]:
        """Synced columns without a null or a default that a client must give."""
        t = self.tables[name]
        own = {t.pk, t.updated_at, t.deleted_at, "created_at"}
        return [f.name for f in self.spark.table(name).schema if f.name in t.columns and f.name not in own and not f.nullable and "CURRENT_DEFAULT" not in f.metadata]

    def manifest(self) -> list[dict]:
        """Synced columns of every table by name, with portable types."""
        out = []
        for name in sorted(self.tables):
            held = {f.name: f for f in self.spark.table(name).schema}
            out += [{"table_name": name, "column_name": c, "portable_type": of_spark(held[c].dataType)} for c in self.tables[name].columns]
        return out


def schema_hash(manifest: list[dict]) -> str:
    return hashlib.md5(json.dumps(manifest, sort_keys=True, separators=(",", ":")).encode(), usedforsecurity=False).hexdigest()


def next_version(history: DataFrame, hash_: str) -> int:
    """The version of a schema: the one that it had (``history``: version, hash), else the largest and 1."""
    had, most = history.agg(F.min(F.when(F.col("hash") == hash_, F.col("version"))), F.coalesce(F.max("version"), F.lit(0))).first()
    return most + 1 if had is None else had


def schema_changes(local: DataFrame, server: DataFrame) -> DataFrame:
    """(table_name, column_name, change) between manifests (table_name, column_name, storage): add_table, add_column, retype or
    local_only, which stays. Equal columns are left out."""
    key = ["table_name", "column_name"]
    known = local.select("table_name").distinct().withColumn("known", F.lit(True))
    met = server.select(*key, F.col("storage").alias("new")).join(local.select(*key, F.col("storage").alias("old")), key, "full").join(known, "table_name", "left")
    change = (
        F.when(F.col("new").isNull(), "local_only").when(F.col("known").isNull(), "add_table").when(F.col("old").isNull(), "add_column")
        .when(F.upper("old") != F.upper("new"), "retype")
    )
    return met.select(*key, change.alias("change")).filter("change is not null")


def migration(changes: DataFrame) -> str:
    """``rebuild`` if a column changes its storage type (queue and scopes are cleared), ``add`` for new columns or tables, else ``none``."""
    kinds = {r["change"] for r in changes.select("change").distinct().collect()}  # at most four
    return "rebuild" if "retype" in kinds else "add" if kinds & {"add_table", "add_column"} else "none"


def connect_action(client: tuple[int, str], server: tuple[int, str]) -> str:
    """What a client does about its schema (version, hash)."""
    return "none" if client == server else "replace"
