"""Binary messages of a PostgreSQL replication stream (pgoutput, protocol 1) as change rows.

Relation messages say which columns a relation id stands for; the latest one before a change counts, so a batch brings what it
needs or the relations known so far are passed along. Begin, commit, origin, type and truncate messages, and unknown ones, are ignored; a message
that can't be read becomes a row with ``error`` and no other row is lost.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RELATIONS = "position long, relation long, table_name string, columns array<string>, keys array<string>"
CHANGES = "position long, relation long, kind string, new array<struct<kind:string,value:string>>, old array<struct<kind:string,value:string>>, error string"


class Reader:
    """One message, read from its beginning."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, form: str) -> int:
        (value,) = struct.unpack_from(form, self.raw, self.at)
        self.at += struct.calcsize(form)
        return value

    def letter(self) -> str:
        return chr(self.take(">B"))

    def text(self) -> str:
        end = self.raw.index(b"\0", self.at)
        value, self.at = self.raw[self.at : end].decode(), end + 1
        return value

    def row(self) -> list[dict]:
        """Values of a tuple: n null, t text, u unchanged and not sent."""
        out = []
        for _ in range(self.take(">H")):
            kind, value = self.letter(), None
            if kind == "t":
                size = self.take(">I")
                if self.at + size > len(self.raw):
                    raise ValueError("a value runs over the message's end")
                value = self.raw[self.at : self.at + size].decode()
                self.at += size
            elif kind not in "nu":
                raise ValueError(f"unknown kind of value {kind!r}")
            out.append({"kind": kind, "value": value})
        return out


def relations(messages: DataFrame) -> DataFrame:
    """Of ``messages`` (position, message: binary) the relation messages."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for position, raw in zip(part["position"], part["message"], strict=True):
                r = Reader(bytes(raw))
                if r.letter() != "R":
                    continue
                relation, _, name, _ = r.take(">I"), r.text(), r.text(), r.letter()
                columns = []
                for _ in range(r.take(">H")):
                    flag, column, _, _ = r.take(">B"), r.text(), r.take(">I"), r.take(">i")
                    columns.append((column, flag & 1))
                rows.append((position, relation, name, [c for c, _ in columns], [c for c, key in columns if key]))
            yield pd.DataFrame(rows, columns=["position", "relation", "table_name", "columns", "keys"])

    return messages.filter(F.substring("message", 1, 1) == F.lit(b"R")).select("position", "message").mapInPandas(run, RELATIONS)


def tuples(messages: DataFrame) -> DataFrame:
    """The inserts, updates and deletes of ``messages`` with their values by place."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for position, raw in zip(part["position"], part["message"], strict=True):
                try:
                    r = Reader(bytes(raw))
                    kind, relation, old = r.letter(), r.take(">I"), None
                    mark = r.letter()
                    if mark in "KO":  # the key or the whole row as it was
                        old = r.row()
                        mark = r.letter() if kind == "U" else None
                    rows.append((position, relation, kind, r.row() if mark == "N" else None, old, None))
                except (ValueError, struct.error) as e:
                    rows.append((position, None, None, None, None, f"undecodable message: {e}"))
            yield pd.DataFrame(rows, columns=["position", "relation", "kind", "new", "old", "error"]).astype({"relation": "Int64"})

    some = F.substring("message", 1, 1).isin([F.lit(c) for c in (b"I", b"U", b"D")])
    return messages.filter(some).select("position", "message").mapInPandas(run, CHANGES)


def named(columns: Column, row: Column) -> Column:
    """A row as a map from column to text; what was not sent is absent, which is not null."""
    pairs = F.filter(F.arrays_zip(columns.alias("name"), row.alias("cell")), lambda p: p["cell"]["kind"] != "u")
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["name"].alias("key"), p["cell"]["value"].alias("value"))))


def decode(messages: DataFrame, known: DataFrame, registered: DataFrame) -> DataFrame:
    """(position, table_name, kind, record_id, data map<string,string>, deleted_at, error) for changes to registered tables, in the form that :func:`tidescope.streaming.decode` takes.

    ``known``: relations of earlier batches (relation, table_name, columns, keys); a later one of the batch takes their place. ``registered``: table_name, pk,
    deleted_at. A change without a value for its key is an error.
    """
    every = known.select(F.lit(-1).cast("long").alias("position"), "relation", "table_name", "columns", "keys").unionByName(relations(messages))
    per = every.groupBy("relation").agg(F.array_sort(F.collect_list(F.struct("position", "table_name", "columns", "keys"))).alias("versions"))  # a row for each table
    found = tuples(messages).alias("m").join(F.broadcast(per), "relation", "left")
    at = F.element_at(F.filter("versions", lambda v: v["position"] < F.col("m.position")), -1)
    found = found.withColumn("table", at).withColumn("lost", F.col("error").isNull() & F.col("table").isNull())
    new, old = named(F.col("table.columns"), F.col("new")), named(F.col("table.columns"), F.col("old"))
    data = F.when(F.col("new").isNotNull(), new).otherwise(old)
    met = found.select("position", F.col("table.table_name").alias("table_name"), "kind", data.alias("data"), F.when(F.col("lost"), "change to an unknown relation").otherwise(F.col("error")).alias("error"))
    met = met.join(F.broadcast(registered.select("table_name", "pk", "deleted_at", F.lit(True).alias("synced"))), "table_name", "left").filter("synced or error is not null")
    key = F.col("data")[F.col("pk")]
    wrong = F.when(F.coalesce(key, F.lit("")) == "", "record without a primary key")
    gone = F.when(F.col("kind") == "U", F.col("data")[F.col("deleted_at")])
    return met.select("position", "table_name", "kind", key.alias("record_id"), "data", gone.alias("deleted_at"), F.coalesce("error", wrong).alias("error"))
