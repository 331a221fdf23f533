"""Small helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROOT = str(Path(__file__).resolve().parents[2])

#: Text bytes that a Python worker handles at once. Bounds a worker's memory whatever a partition's size.
BLOCK_BYTES = 6 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepared(df: DataFrame) -> DataFrame:
    """Lets Python workers on this machine import the package even if the driver found it by sys.path only."""
    env = df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return df


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder (spark.checkpoint.dir). Only a session that runs in one process may lack one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="recordloom-"))
    return sc.getCheckpointDir()


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, if it is there, wherever its file system is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """The rows written to the cluster's checkpoint folder, so that neither lost executors nor later uses recompute them.

    Spark removes the files once nothing refers to them if spark.cleaner.referenceTracking.cleanCheckpoints is set.

    A checkpoint keeps its plan's estimated size, which for a join is the product of both sides: over the rounds of a
    loop that grows to numbers of megabytes each in the driver. So the rows go into a table that has no estimate.
    """
    spark = df.sparkSession
    shared_folder(spark)
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


#: Narrow rows (some ten to a hundred bytes each) that are broadcast at most, and keys of rows that go; more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_KEYS = 1 << 14, 1 << 18


def beside(df: DataFrame, most: int | None = None) -> DataFrame:
    """A durable table as the side of a join: broadcast if it has few rows; else plain, so that Spark may split hot keys."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if most is None else most) else df


def free_name(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def plain_files(df: DataFrame) -> bool:
    """Whether df is rows of one table in Parquet files, maybe filtered or projected."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return plan.getClass().getSimpleName() == "LogicalRelation" and "parquet" in plan.toString().rpartition(" ")[2]


def row_keyed(df: DataFrame) -> tuple[DataFrame, str]:
    """df with a key of each row, and the key's column name. A row has the same key however often and by whatever splits it is read.

    The key is the place in the files (a hash of the file's path, and the row's index there). Rows that don't come
    straight from Parquet files are written once and numbered as written.
    """
    name = free_name(df, "row")
    if plain_files(df):
        place = df.metadataColumn("_metadata")
        return df.select("*", F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at")).alias(name)), name
    kept = durable(df.select("*", F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at")).alias(name)))
    return kept, name


def without_rows(keyed: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """The rows of keyed but those of the keys dropped (its one column), without the key."""
    return keyed.join(beside(durable(dropped.toDF(key)), BROADCAST_KEYS), key, "left_anti").drop(key)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def keyed_texts(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """doc_id, text and what else is asked for, null texts as empty ones; other columns, whatever their names, don't take part."""
    return prepared(df.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"), *more))


def schema_with(df: DataFrame, more: str) -> StructType:
    """df's columns without `text`, and the columns of the schema string."""
    return StructType([f for f in df.schema if f.name != "text"] + StructType.fromDDL(more).fields)


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """The rows of a partition again, as tables of about limit bytes of text each; a row is never split."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        start = 0
        column = batch.column(batch.schema.get_field_index(text))
        lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths):
            size += int(n)
            if size >= limit:
                held.append(batch.slice(start, i + 1 - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, i + 1
                released()
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
    held.clear()
    released()


def released() -> None:
    """Gives freed memory back to the system: workers are used again by later stages, beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library is glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)
