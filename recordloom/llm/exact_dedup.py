"""Exact de-duplication by an exchange of Golomb-coded fingerprints.

1. Each block of rows hashes its texts to 64 bits and sends each owner of a hash range one message: its distinct
   hashes of that range, sorted, as Golomb-Rice coded gaps, with a bitmap of those it holds more than once.
2. An owner decodes its messages, finds hashes that more than one block (or one block twice) holds, and answers each
   message with a bitmap.
3. Blocks read the bitmaps against their own messages. Only rows whose hash was marked, the suspects, are shuffled
   with their texts, and only one of each text for each task: texts are grouped byte for byte, pre-aggregated.
4. Narrow rows (id, hash, digest) get the kept row of their verified group.

A block sends each hash once, so a text that a third of all rows share is one entry of each message. Blocks and owners
hold a fixed number of hashes however many partitions there are, so messages are as many as the square of the hashes'
number by BLOCK_ROWS x OWNER_HASHES: a hundred hashes each at 10^11 rows. Verdicts, one row for each group of copies, are
written down and then joined to the rows: broadcast while they are few, else by a plain join whose hot keys Spark splits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.common import beside, durable, prepared, row_keyed, shuffle_partitions, table, text_or_empty

#: Rows of a block, and hashes that an owner holds at once: bounds of a worker's memory.
BLOCK_ROWS = 1 << 21
OWNER_HASHES = 1 << 20


def rice_encode(gaps: np.ndarray) -> bytes:
    """Golomb-Rice code of non-negative gaps: a byte for the width, then unary quotients, then fixed-width rests."""
    if not len(gaps):
        return b""
    mean = int(gaps.mean(dtype=np.float64)) if len(gaps) else 0
    width = max(0, min(56, mean.bit_length() - 1))
    quotients = (gaps >> np.uint64(width)).astype(np.int64)
    ends = np.cumsum(quotients + 1)
    unary = np.ones(int(ends[-1]), np.uint8)
    unary[ends - 1] = 0
    shifts = np.arange(width - 1, -1, -1, dtype=np.uint64)
    rests = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return bytes([width]) + np.packbits(unary).tobytes() + np.packbits(rests).tobytes()


def rice_decode(code: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    width, bits = code[0], np.unpackbits(np.frombuffer(code, np.uint8, offset=1))
    split = len(bits) - (-(-n * width // 8) * 8)
    ends = np.flatnonzero(bits[:split] == 0)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    rests = bits[split : split + n * width].reshape(n, width)
    out = quotients.astype(np.uint64) << np.uint64(width)
    for j in range(width):
        out |= rests[:, j].astype(np.uint64) << np.uint64(width - 1 - j)
    return out


def hash_list(code: bytes, n: int) -> np.ndarray:
    return np.cumsum(rice_decode(code, n), dtype=np.uint64)


MESSAGE = "owner int, block long, n int, hashes binary, twice binary"


def messages(owners: int):  # noqa: ANN201
    """mapInArrow function: the messages of each block of a partition."""

    def one(h: np.ndarray, block: int) -> pa.RecordBatch:
        distinct, counts = np.unique(h, return_counts=True)
        owner = ((distinct >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
        cut = np.flatnonzero(np.diff(owner.astype(np.int64), prepend=-1))
        out = [(int(owner[a]), block, b - a, rice_encode(np.diff(distinct[a:b], prepend=np.uint64(0))), np.packbits(counts[a:b] > 1).tobytes()) for a, b in zip(cut, [*cut[1:], len(distinct)], strict=True)]
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([int(x) if t != pa.binary() else x for x in c], t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["owner", "block", "n", "hashes", "twice"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        first, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) >= BLOCK_ROWS:
                yield one(np.concatenate(held), first + n)
                held, n = [], n + 1
        if sum(map(len, held)):
            yield one(np.concatenate(held), first + n)

    return run


def answers(got: pd.DataFrame) -> pd.DataFrame:
    """An owner's bitmaps: which hashes of each message are held twice anywhere."""
    lists = [hash_list(c, n) for c, n in zip(got["hashes"], got["n"], strict=True)]
    twice = [np.unpackbits(np.frombuffer(t, np.uint8), count=n).astype(bool) for t, n in zip(got["twice"], got["n"], strict=True)]
    distinct, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    marked = counts > 1
    np.logical_or.at(marked, inverse, np.concatenate(twice))
    maps = np.split(marked[inverse], np.cumsum([len(x) for x in lists])[:-1])
    return pd.DataFrame({"owner": got["owner"], "block": got["block"], "bitmap": [np.packbits(m).tobytes() for m in maps]})


def suspects(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a block reads off an answered message: its hashes that are marked."""
    for batch in batches:
        for n, code, bitmap in zip(*(batch.column(c).to_pylist() for c in ("n", "hashes", "bitmap")), strict=True):
            marked = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=n).astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(hash_list(code, n)[marked].view(np.int64))], names=["h"])


def marked_hashes(narrow: DataFrame) -> DataFrame:
    """Distinct hashes (column h) that more than one row of narrow holds."""
    least, n = shuffle_partitions(narrow.sparkSession), narrow.count()
    owners = max(least, -(-n // OWNER_HASHES))
    sent = durable(narrow.select("h").coalesce(max(least, -(-n // BLOCK_ROWS))).mapInArrow(messages(owners), MESSAGE))
    answered = sent.groupBy("owner").applyInPandas(answers, "owner int, block long, bitmap binary")
    return sent.join(answered, ["owner", "block"]).select("n", "hashes", "bitmap").mapInArrow(suspects, "h long").distinct()


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None) -> DataFrame:
    """Groups of equal texts: doc_id, row (the row's key), keep_id, group_size, kept, text_sha256.

    One row for each row of df. Null texts are empty texts. The row with the largest id is kept; null ids are
    smallest; of repeated rows with the largest id exactly one is kept. An empty table gives no rows. The key's column
    may be given where df has one from row_keyed.
    """
    if key is None:
        df, key = row_keyed(df)
    texts = prepared(df.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"), F.col(f"`{key}`").alias("row")))
    texts = texts.withColumn("h", F.xxhash64("text"))
    narrow = durable(texts.select("doc_id", "h", F.sha2("text", 256).alias("text_sha256"), "row"))
    marked = beside(durable(marked_hashes(narrow)))
    shuffled = texts.join(marked, "h", "left_semi")
    same = shuffled.groupBy("h", "text").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", F.sha2("text", 256).alias("text_sha256"))
    verified = same.groupBy("h", "text_sha256").agg(F.count(F.lit(1)).alias("texts"))
    verified = verified.where(F.when(F.col("texts") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("different texts share both digests")).cast("boolean"))).select("h", "text_sha256")
    top = F.max(F.struct("doc_id", "row"))
    kept = narrow.join(marked, "h", "left_semi").groupBy("h", "text_sha256").agg(top.alias("top"), F.count(F.lit(1)).alias("group_size"))
    kept = beside(durable(kept.join(verified, ["h", "text_sha256"]).select("h", "text_sha256", "top", "group_size")))
    out = narrow.join(kept, ["h", "text_sha256"], "left")
    return out.select("doc_id", "row", F.when(F.col("top").isNotNull(), F.col("top.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.coalesce(F.col("top.row") == F.col("row"), F.lit(True)).alias("kept"), "text_sha256")


def op5_golomb_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).drop("row")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
