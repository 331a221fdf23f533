"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Vectors are rows of integer weights. A block of candidate rows becomes postings (component -> rows and weights); each
query row scatters query weight x posting weight into a dense score array over the block, one component at a time;
the block's k best are selected by partition, and the best of all blocks are merged: in each task first, then by query.

Candidates and queries are packed into blocks of rows, one row of a table each, and the query set meets all candidates
block by block, in one job: query blocks are broadcast up to BROADCAST_BYTES, else Spark pairs the partitions of both,
which tasks read from storage. The driver sees neither.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.llm.common import durable, prepared, row_keyed, table

#: Candidate rows and query rows of a block; a dense score array has as many cells (4 or 8 bytes each).
ROWS, QUERIES, TILE = 2048, 512, 32
#: Bytes of query vectors that are broadcast at most.
BROADCAST_BYTES = 32 << 20
#: Weights beyond this are counted with whole numbers of any size. Below, 4096 products fit 62 bits.
BIG = 1 << 25
LEAST, MOST = -(1 << 63) + 1, (1 << 63) - 1

Rows = Iterable[pa.RecordBatch]


def vectors_of(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, a key of each row (file, at) and x; rows whose vector is null or holds null or non-finite values go."""
    keyed, key = row_keyed(df)
    x = F.col(f"`{vector_col}`")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return prepared(keyed.where(F.coalesce(fine, F.lit(False))).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{key}`.file").alias("file"), F.col(f"`{key}`.at").alias("at"), x.alias("x")))


BLOCK = "ids binary, known binary, file binary, at binary, lengths binary, x binary"


def packer(size: int, single: bool) -> Callable[[Rows], Iterator[pa.RecordBatch]]:
    """mapInArrow function: blocks of at most size rows, by id (null ids last), each a row of byte strings."""

    def run(batches: Rows) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, size):
                part = batch.slice(low, size)
                part = part.take(pa.compute.sort_indices(part, sort_keys=[("vec_id", "ascending")]))
                ids, x = part.column("vec_id"), part.column("x")
                lengths = x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
                values = x.flatten().to_numpy(zero_copy_only=False).astype(np.float32 if single else np.float64)
                arrays = [ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), *(part.column(c).to_numpy(zero_copy_only=False) for c in ("file", "at")), lengths, values]
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names=[f.split(" ")[0] for f in BLOCK.split(", ")])

    return run


class Block:
    """Rows of integer vectors floor(256 x): ids, keys, a dense matrix, and which rows hold weights beyond BIG."""

    def __init__(self, columns: list[bytes], single: bool) -> None:
        self.ids, self.known, self.file, self.at, lengths, x = (np.frombuffer(c, kind) for c, kind in zip(columns, (np.int64, np.uint8, np.int64, np.int64, np.int32, np.float32 if single else np.float64), strict=True))
        self.width = int(lengths.max(initial=0))
        rows, places = np.repeat(np.arange(len(lengths)), lengths), np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        weights = np.floor(np.clip(x.astype(np.float64), -1e300, 1e300) * 256)
        self.big = np.zeros(len(lengths), bool)
        self.big[rows[np.abs(weights) > BIG]] = True
        self.exact = {int(r): [floor(v * 256) if abs(v) < 1e300 else int(v) * 256 for v in map(float, x[rows == r])] for r in np.flatnonzero(self.big)}
        self.matrix = np.zeros((len(lengths), self.width), np.int64)
        plain = ~self.big[rows]
        self.matrix[rows[plain], places[plain]] = weights[plain].astype(np.int64)

    def whole(self, row: int) -> list[int]:
        return self.exact[row] if self.big[row] else self.matrix[row].tolist()

    def postings(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(component, rows, weights) of all weights that aren't 0."""
        for term in range(self.width):
            rows = np.flatnonzero(self.matrix[:, term])
            if len(rows):
                yield term, rows, self.matrix[rows, term]


def accumulated(block: Block, asks: Block) -> np.ndarray:
    """Scores of each block row (second axis) for each query (first axis), kept within the range of a long."""
    most = float(np.abs(block.matrix).max(initial=0)) * float(np.abs(asks.matrix).max(initial=0)) * max(1, min(block.width, asks.width))
    kind = np.int32 if most < 2**31 else np.int64
    if most >= 2**62:  # thousands of components near BIG
        block.big[:], asks.big[:] = True, True
        block.exact, asks.exact = ({r: x.exact.get(r) or x.matrix[r].tolist() for r in range(len(x.ids))} for x in (block, asks))
    scores, queries = np.zeros((len(asks.ids), len(block.ids)), kind), asks.matrix.astype(kind)
    posted = [(term, rows, weights.astype(kind)) for term, rows, weights in block.postings() if term < asks.width]
    for low in range(0, len(queries), TILE):  # so many queries that their scores stay in the processor's cache
        part = scores[low : low + TILE]
        for term, rows, weights in posted:
            wanted = np.flatnonzero(queries[low : low + TILE, term])
            if not len(wanted):
                continue
            some = queries[low + wanted, term, None]
            if 2 * len(rows) > len(block.ids):  # few weights are 0: add to whole rows
                full = np.zeros(len(block.ids), kind)
                full[rows] = weights
                if len(wanted) == len(part):
                    part += some * full
                else:
                    part[wanted] += some * full
            else:
                part[np.ix_(wanted, rows)] += some * weights
    if block.big.any() or asks.big.any():
        scores = scores.astype(np.int64)
        for q, r in zip(*np.nonzero(asks.big[:, None] | block.big), strict=True):
            exact = sum(a * b for a, b in zip(asks.whole(int(q)), block.whole(int(r)), strict=False))
            scores[q, r] = min(MOST, max(LEAST, exact))
    return scores


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """For each query, columns of the k highest scores that are allowed (ties to the smaller column), then others."""
    n = scores.shape[1]
    if n <= k:
        order = np.lexsort((np.broadcast_to(np.arange(n), scores.shape), -scores, ~allowed), axis=1)
        return order[:, :k]
    if np.abs(scores).max(initial=0) < 2**62 // n:
        rank = np.where(allowed, scores.astype(np.int64) * n + (n - 1 - np.arange(n)), np.iinfo(np.int64).min)
        top = np.argpartition(rank, n - k, axis=1)[:, n - k :]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(rank, top, axis=1), axis=1), axis=1)
    first = np.argsort(~allowed, axis=1, kind="stable")[:, :k]
    for q in range(len(scores)):
        pool = np.flatnonzero(allowed[q])
        found = pool[np.lexsort((pool, -scores[q, pool]))[:k]]
        first[q, : len(found)] = found
    return first


RESULT = "file long, at long, query_id long, vec_id long, score long"


def searched(k: int, single: bool) -> Callable[[Rows], Iterator[pa.RecordBatch]]:
    """mapInArrow function over pairs of a candidate and a query block: a task's k best rows for each of its queries."""

    def run(batches: Rows) -> Iterator[pa.RecordBatch]:
        asked: dict[bytes, tuple[Block, np.ndarray]] = {}
        last: tuple[bytes, Block] | None = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = row[8] + row[9]  # the queries' rows
                if key not in asked:
                    asks = Block(list(row[6:]), single)
                    asked[key] = asks, np.zeros((4, len(asks.ids), 0), np.int64)
                asks, kept = asked[key]
                name = row[2] + row[3]
                if last is None or last[0] != name:
                    last = name, Block(list(row[:6]), single)
                block = last[1]
                scores = accumulated(block, asks)
                allowed = (block.file != asks.file[:, None]) | (block.at != asks.at[:, None])
                top = best(scores, allowed, k)
                found = np.stack([np.take_along_axis(allowed, top, axis=1), np.take_along_axis(scores, top, axis=1), block.known[top], block.ids[top]]).astype(np.int64)
                kept = np.concatenate([kept, found], axis=2)
                order = np.lexsort((kept[3], -kept[2], -kept[1], -kept[0]), axis=1)[:, :k]
                asked[key] = asks, np.take_along_axis(kept, order[None], axis=2)
        for asks, kept in asked.values():
            q, j = np.nonzero(kept[0])
            _, score, known, ids = kept[:, q, j]
            columns = [pa.array(asks.file[q]), pa.array(asks.at[q]), pa.array(asks.ids[q], mask=asks.known[q] == 0), pa.array(ids, mask=known == 0), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split(" ")[0] for f in RESULT.split(", ")])

    return run


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The k highest-scoring other rows of each query row: query_id, rank from 1, vec_id, score; ties to smaller vec_id.

    is_query tests the column vec_id. Only a query's own row is left out; further rows with its id are candidates, and a
    repeated query row is a query of its own. Null ids are candidates whose ties come last. Vectors of unequal length
    are compared over their common components. Scores beyond the range of a long count as its ends. No queries, no rows.
    """
    single = df.schema[vector_col].dataType.elementType.simpleString() == "float"
    vectors = vectors_of(df, id_col, vector_col)
    asks = durable(vectors.where(is_query).mapInArrow(packer(QUERIES, single), BLOCK)).toDF(*(f"q{i}" for i in range(6)))
    blocks = vectors.mapInArrow(packer(ROWS, single), BLOCK)
    # The stated query set against all rows, block by block.
    size = asks.agg(F.coalesce(F.sum(F.octet_length("q5").cast("long")), F.lit(0))).first()[0]
    pairs = blocks.crossJoin(F.broadcast(asks)) if size <= broadcast_bytes else durable(blocks).crossJoin(asks)
    found = pairs.mapInArrow(searched(k, single), RESULT)
    order = Window.partitionBy("file", "at").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    near = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return near.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5
"""
