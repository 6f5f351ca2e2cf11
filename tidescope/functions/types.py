"""Portable column types: ten names, and the aliases that lead to them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Database type names by portable type.
EXACT = {
    "string": ["text", "uuid", "varchar", "character", "interval", "inet", "cidr", "macaddr", "macaddr8", "xml", "point", "line", "lseg", "box", "path", "polygon", "circle", "string"],
    "int": ["smallint", "integer", "int", "int32"],
    "int64": ["bigint", "int64"],
    "float": ["numeric", "decimal", "real", "double precision", "float", "float64"],
    "boolean": ["boolean", "bool"],
    "datetime": ["timestamp", "timestamp with time zone", "timestamp without time zone", "datetime"],
    "date": ["date"],
    "time": ["time", "time without time zone"],
    "json": ["json", "jsonb"],
    "bytes": ["bytea", "bytes", "blob"],
}
#: Storage class of each portable type on a client.
STORAGE = {"string": "TEXT", "int": "INTEGER", "int64": "INTEGER", "float": "REAL", "boolean": "INTEGER", "datetime": "TEXT", "date": "TEXT", "time": "TEXT", "json": "TEXT", "bytes": "BLOB"}
SPARK = {"string": T.StringType(), "int": T.IntegerType(), "int64": T.LongType(), "float": T.DoubleType(), "boolean": T.BooleanType(), "datetime": T.TimestampType(), "date": T.DateType(), "time": T.StringType(), "json": T.StringType(), "bytes": T.BinaryType()}
BY_NAME = {alias: portable for portable, aliases in EXACT.items() for alias in aliases}


def portable(name: str) -> str | None:
    """The portable type of a database type name; None for an unknown one."""
    n = name.strip().lower()
    if n.endswith("[]"):
        return "json"
    if n.startswith(("numeric(", "decimal(")):
        return "float"
    if n.startswith(("varchar(", "character varying", "character(")):
        return "string"
    if n.endswith("range"):
        return "string"
    return BY_NAME.get(n)


def portable_column(name: Column) -> Column:
    """The same rules, in the same order, as an expression."""
    n = F.lower(F.trim(name))
    exact = F.create_map(*[F.lit(x) for pair in BY_NAME.items() for x in pair])
    return (
        F.when(n.endswith("[]"), "json").when(n.rlike(r"^(numeric|decimal)\("), "float")
        .when(n.rlike(r"^(varchar\(|character varying|character\()"), "string").when(n.endswith("range"), "string").otherwise(exact[n])
    )


def of_spark(kind: T.DataType) -> str:
    """The portable type of a Spark column."""
    simple = kind.simpleString()
    for portable_name, names in {"int": ("tinyint", "smallint", "int"), "int64": ("bigint",), "boolean": ("boolean",), "date": ("date",), "datetime": ("timestamp", "timestamp_ntz"), "bytes": ("binary",)}.items():
        if simple in names:
            return portable_name
    if simple in ("float", "double") or simple.startswith("decimal"):
        return "float"
    return "json" if isinstance(kind, T.ArrayType | T.MapType | T.StructType) else "string"
