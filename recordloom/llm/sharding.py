"""Reproducible sharding: a Feistel permutation of global row numbers.

Rows get global numbers in the order (id, CRC-32 of the text, size); a keyed permutation of 0..n-1 then shuffles
them, and place p of the permutation is shard p mod k, slot p div k. Anyone who knows n, k and the key can compute
where a row number lies, or which row number lies in a slot, without the table.

The permutation is an unbalanced Feistel network over a grid of a x b cells, the smallest near-square grid that has n
cells. Its few surplus cells are left by cycle walking: a number that lands on one is permuted again.

Only narrow rows (id, size, checksum) are sorted; texts never move. The sort is by range, and rows that are equal in all
three, which are interchangeable, go by where they were read, so that however many there are, they spread over
partitions as any other rows do. The one broadcast holds a row for each partition.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.llm.common import durable, table, text_or_empty

ROUNDS = 8
#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Cycle walking that goes on for longer than this fails loudly. With n rows a step goes on with a chance under
#: 1 / sqrt(n), and small tables have fewer surplus cells than this.
WALK = 64


def grid(n: int) -> tuple[int, int]:
    a = isqrt(max(n, 1) - 1) + 1 if n > 0 else 1
    return a, max(1, -(-n // a))


def permuted(row: Column, n: int, key: int, rounds: int = ROUNDS) -> Column:
    """Place of a row number (0 to n - 1) in the permutation."""
    a, b = (F.lit(x).cast("long") for x in grid(n))
    steps = F.array(*[F.lit(r) for r in range(rounds)])

    def mixed(x: Column, r: Column, size: Column) -> Column:
        return F.pmod(F.xxhash64(x, r, F.lit(key).cast("long")), size)

    def once(x: Column) -> Column:
        def step(at: Column, r: Column) -> Column:
            left, right = at["l"], at["r"]
            return F.when(r % 2 == 0, F.struct(((left + mixed(right, r, a)) % a).alias("l"), right.alias("r"))).otherwise(F.struct(left.alias("l"), ((right + mixed(left, r, b)) % b).alias("r")))

        start = F.struct(((x - x % b) / b).cast("long").alias("l"), (x % b).alias("r"))
        return F.aggregate(steps, start, step, lambda at: at["l"] * b + at["r"])

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(row), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """The rows with `row`, gapless from 0 in the given order, and their number."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = durable(ordered).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    counts = held.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = durable(counts.select("part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    n = offsets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # One row for each partition of the sort.
    return held.join(F.broadcast(offsets.drop("n")), "part").withColumn("row", F.col("offset") + F.col("at")).drop("part", "at", "offset"), int(n)


def shard(df: DataFrame, shards: int = 40, key: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row under the law `rows`: row counts of shards are at most one apart, slots gapless.

    Rows of equal texts are rows like any other. Null texts count as empty; null ids sort first; repeated rows each
    get a place of their own; an empty table gives no rows. grown_shard is null, as this law moves rows when shards
    are added.
    """
    text = text_or_empty(text_col)
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed, n = numbered(rows.withColumn("read", F.monotonically_increasing_id()), ["doc_id", "text_crc32", "size", "read"])
    at = placed.withColumn("place", permuted(F.col("row"), n, key))
    return at.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"), ((F.col("place") - F.col("place") % shards) / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
