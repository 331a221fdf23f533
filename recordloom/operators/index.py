"""Indexes over records: packed and exploded inverted indexes, the numeric index and the key-type profile.

All start from pairs (uuid, key, packed value). Distinct rows and counts are pre-aggregated before their one shuffle; ids of
packed rows are sorted after it. Rows of the packed index and the profile hold all ids of a value by definition; for
values that a large share of records has, `chunks` deals their ids over several rows by a hash of the id, and the
exploded index has no such rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.codec import classify, elements, norm

#: Ids of a packed row that are sorted and joined at once.
RUN = 4096


def pairs_of(records: DataFrame) -> DataFrame:
    return records.select("uuid", F.explode("fields").alias("key", "value"))


def _chunk(chunks: int) -> Column:
    return F.pmod(F.xxhash64("uuid"), F.lit(chunks)).cast("int") if chunks > 1 else F.lit(0)


def _listed(pairs: DataFrame, keys: list[str], chunks: int) -> DataFrame:
    """keys and uuids: sorted apart in spilling sorts and joined run by run, so that no task holds all ids as objects."""
    group = [*keys, "chunk"]
    rank = F.dense_rank().over(Window.partitionBy(*group).orderBy("uuid"))
    placed = pairs.select(*keys, "uuid", _chunk(chunks).alias("chunk")).withColumn("run", F.floor((rank - 1) / RUN))
    runs = placed.groupBy(*group, "run").agg(F.array_join(F.array_sort(F.collect_set("uuid")), ",").alias("ids"))
    listed = runs.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("run", "ids"))).alias("runs"))
    return listed.select(*keys, F.array_join(F.col("runs.ids"), ",").alias("uuids"))


def packed_by_key(pairs: DataFrame, chunks: int = 1) -> DataFrame:
    """key, value and uuids, the sorted ids joined by commas; arrays are values like others."""
    return _listed(pairs, ["key", "value"], chunks)


def packed_by_value(pairs: DataFrame, chunks: int = 1) -> DataFrame:
    return packed_by_key(pairs, chunks).select("value", "key", "uuids")


def universe(pairs: DataFrame) -> DataFrame:
    return pairs.select("uuid").distinct()


def exploded_by_key(pairs: DataFrame) -> DataFrame:
    """Distinct (key, element, uuid). A malformed array raises, an empty one has no rows."""
    return pairs.select("key", F.explode(elements(F.col("value"))).alias("value"), "uuid").distinct()


def exploded_by_value(pairs: DataFrame) -> DataFrame:
    return exploded_by_key(pairs).select("value", "key", "uuid")


def numeric(exploded: DataFrame) -> DataFrame:
    """norm, key, value and uuid of number-shaped elements; the byte order of norm is numeric order."""
    return exploded.select(norm(F.col("value")).alias("norm"), "key", "value", "uuid").where("norm IS NOT NULL")


def profile(pairs: DataFrame, chunks: int = 1) -> DataFrame:
    """key, type, count and uuids of each class of whole values under a key. A row of several chunks counts its own ids."""
    typed = pairs.select("key", classify(F.col("value")).alias("type"), "uuid")
    return typed.groupBy("key", "type", _chunk(chunks).alias("chunk")).agg(F.count(F.lit(1)).alias("count"), F.array_join(F.array_sort(F.collect_list("uuid")), ",").alias("uuids")).drop("chunk")
