"""Test data from a seed: a category tree, documents with members and threaded comments, and the test tables as rows of an application.

Every value follows from its row's number by hashing, so tables of any size are made in parallel and alike each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescope.functions.canonical import deterministic_uuid


def unit(seed: int, *keys: Column) -> Column:
    """A number from 0 (included) to 1 that looks random."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / (1 << 40)


def categories(spark: SparkSession, roots: int = 5, branches: int = 4, leaves: int = 3) -> DataFrame:
    """(id, parent_id, name, level): a tree of three levels."""
    n = F.col("id")
    at = lambda level, key: deterministic_uuid(f"category{level}", key)
    one = spark.range(roots).select(at(1, n).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.concat(F.lit("Category "), n).alias("name"), F.lit(1).alias("level"))
    two = spark.range(roots * branches).select(at(2, n), at(1, F.floor(n / branches)), F.concat(F.lit("Category "), F.floor(n / branches), F.lit("."), n % branches), F.lit(2))
    three = spark.range(roots * branches * leaves).select(at(3, n), at(2, F.floor(n / leaves)), F.concat(F.lit("Category "), F.floor(n / (leaves * branches)), F.lit("."), F.floor(n / leaves) % branches, F.lit("."), n % leaves), F.lit(3))
    return one.union(two).union(three)


def weighted_user(seed: int, users: int, key: Column) -> Column:
    """One of ``users`` numbers, the i-th (from 0) with weight 1 / (i + 1)."""
    total = sum(1 / (i + 1) for i in range(users))
    bounds, run = [], 0.0
    for i in range(users - 1):
        run += 1 / (i + 1) / total
        bounds.append(run)
    draw = unit(seed, key)
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<double>"), lambda b: b <= draw)).cast("int")


def documents(spark: SparkSession, count: int, users: int, seed: int = 42) -> DataFrame:
    """(id, number, owner, members): the number of members is Pareto distributed, most documents have one or two."""
    n = F.col("id")
    members = F.least(F.lit(users), F.floor(F.pow(1 - unit(seed, n), F.lit(-1 / 1.5)))).cast("int")
    return spark.range(count).select(deterministic_uuid("document", n).alias("id"), n.alias("number"), weighted_user(seed + 1, users, n).alias("owner"), members.alias("members"))


def members(docs: DataFrame, users: int) -> DataFrame:
    """(document_id, user, role): the owner and the users after them, each once."""
    places = docs.select(F.col("id").alias("document_id"), "owner", F.explode(F.sequence(F.lit(0), F.col("members") - 1)).alias("place"))
    role = F.when(F.col("place") == 0, "owner").when(F.col("place") % 2 == 1, "editor").otherwise("viewer")
    return places.select("document_id", ((F.col("owner") + F.col("place")) % users).alias("user"), role.alias("role"))


def comments(docs: DataFrame, most: int = 5, seed: int = 42) -> DataFrame:
    """(id, document_id, parent_id, user): up to ``most`` a document; a comment answers an earlier one of its document, or none."""
    total = F.floor(unit(seed + 2, F.col("number")) * (most + 1)).cast("int")
    rows = docs.withColumn("total", total).filter("total > 0").select("id", "number", "owner", F.explode(F.sequence(F.lit(0), F.col("total") - 1)).alias("place"))
    key = lambda place: F.concat(F.col("number"), F.lit(":"), place)
    answered = F.floor(unit(seed + 3, F.col("number"), F.col("place")) * (F.col("place") + 1)).cast("int") - 1
    return rows.select(
        deterministic_uuid("comment", key(F.col("place"))).alias("id"), F.col("id").alias("document_id"),
        F.when(answered >= 0, deterministic_uuid("comment", key(answered))).alias("parent_id"), F.col("owner").alias("user"),
    )


#: What the letters and levels of the test tables are called in the application.
STATUS = {"O": "open", "F": "fulfilled", "P": "processing"}
PRIORITY = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}


def looked_up(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def application_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders as the application has them: ids from keys, status and priority renamed, the customer's id by a join of keys."""
    keys = customers.select(F.col("c_custkey").alias("o_custkey"), deterministic_uuid("customer", F.col("c_custkey")).alias("customer_id"))
    return orders.join(keys, "o_custkey").select(
        deterministic_uuid("order", F.col("o_orderkey")).alias("id"), "customer_id", looked_up(STATUS, F.col("o_orderstatus")).alias("status"),
        looked_up(PRIORITY, F.col("o_orderpriority")).alias("priority"), F.col("o_totalprice").alias("total_price"),
    )


def application_lines(lines: DataFrame) -> DataFrame:
    """Order lines with the price of one piece and the flags as tags."""
    tags = F.array_compact(F.array(F.when(F.col("l_returnflag") == "R", "returned"), F.when(F.col("l_linestatus") == "O", "open")))
    key = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return lines.select(deterministic_uuid("line", key).alias("id"), deterministic_uuid("order", F.col("l_orderkey")).alias("order_id"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"), tags.alias("tags"))
