"""Relational tables as records.

An adapter gives one column for each key, null where a record lacks the key and an array where it has several values;
values are text. `records` packs such columns into the general form uuid, fields. Ids derive from primary keys
arithmetically, so adapting needs no shuffle and filters reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import ids
from recordloom.functions.codec import encode_array


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)").cast("string")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, nation, acctbal, segment; debt where the balance is negative."""
    balance = F.col("c_acctbal").cast("decimal(18,2)")
    return read(spark, sf_dir, "customer").select(
        ids.numbered("C", F.col("c_custkey")).alias("uuid"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("nation"),
        money("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"), F.when(balance < 0, (-balance).cast("string")).alias("debt"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cust, status, total, date; priority unless it isn't specified."""
    return read(spark, sf_dir, "orders").select(
        ids.numbered("O", F.col("o_orderkey")).alias("uuid"), F.col("o_custkey").cast("string").alias("cust"), F.col("o_orderstatus").alias("status"),
        money("o_totalprice").alias("total"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("priority"),
    )


def order_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with part, the sorted distinct part keys of their lines: one shuffle of lines, grouped by order."""
    parts = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("part"))
    return parts.select(ids.numbered("O", F.col("k")).alias("uuid"), "part")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user, type; value of purchases; mixed, whose class cycles by event: number, boolean, timestamp, text, array."""
    value, n = money("value"), F.col("event_id") % 5
    two = F.array(value, F.col("event_type"))
    mixed = F.when(n == 0, value).when(n == 1, (F.col("user_id") % 2 == 0).cast("string")).when(n == 2, F.date_format("ts", "yyyyddMMHHmmss")).when(n == 3, F.col("event_type")).otherwise(encode_array(two))
    return read(spark, sf_dir, "events").select(
        ids.numbered("E", F.col("event_id")).alias("uuid"), F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("type"),
        F.when(F.col("event_type") == "purchase", value).alias("value"), mixed.alias("mixed"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, n_chars and text, the text with a tab, a backslash and an equals sign in front."""
    return read(spark, sf_dir, "documents").select(
        ids.numbered("D", F.col("doc_id")).alias("uuid"), "lang", "source", F.col("n_chars").cast("string").alias("n_chars"), F.concat(F.lit("\t\\="), "text").alias("text"),
    )


def records(wide: DataFrame) -> DataFrame:
    """uuid and fields of a wide table; missing keys are left out, lists become canonical arrays."""
    pairs = [F.struct(F.lit(name).alias("k"), (encode_array(F.col(name)) if kind.startswith("array") else F.col(name).cast("string")).alias("v")) for name, kind in wide.dtypes if name != "uuid"]
    return wide.select("uuid", F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull())).alias("fields"))


def pairs(wide: DataFrame) -> DataFrame:
    """uuid, key and packed value of a wide table, without a map in between."""
    cells = F.array(*[F.struct(F.lit(name).alias("key"), (encode_array(F.col(name)) if kind.startswith("array") else F.col(name).cast("string")).alias("value")) for name, kind in wide.dtypes if name != "uuid"])
    return wide.select("uuid", F.inline(cells)).where("value IS NOT NULL")
