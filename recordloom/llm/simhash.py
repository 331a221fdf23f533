"""Near-duplicates by SimHash: a binary trie self-join of fingerprints, then connected components.

Fingerprints of 64 bits link when at most `budget` bits differ. Cut into blocks of bits, two such fingerprints agree
on all but `budget` blocks; so for every choice of blocks - budget blocks, fingerprints meet that agree there. Those that
meet form a binary trie, which is joined with itself: pairs of nodes are traversed together, differing bits add up, and
a pair is left once they exceed the budget. Every link is found.

Only distinct fingerprints take part, so exact copies cost nothing; links are united within a task, which reports a
spanning forest instead of all pairs. Where more than LIMIT fingerprints share a prefix they are dealt into chunks, and
a task joins two chunks. Components of the forests are found by alternating large-star and small-star steps. Minima and
verdicts, a row for each key, are written down before they are joined, so that they are broadcast while they are few,
and a key that many rows share may be split by Spark beyond.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.common import BROADCAST_ROWS, beside, blocks, durable, keyed_texts, prepared, row_keyed, schema_with, table

SHINGLE, BUDGET, SEED, BITS = 4, 4, 42, 64
#: Hashes whose bits are counted at once.
COUNT_AT_ONCE = 1 << 14
#: Node pairs that are expanded at once, pairs of fingerprints at which a node pair is compared outright, and pairs of fingerprints compared at once.
PAIRS, SMALL, CELLS = 1 << 14, 64, 1 << 18
#: Fingerprints that share a prefix, if they were random.
GROUP = 1 << 12
#: Rows of one key that a task joins; more are dealt into chunks.
LIMIT = 1 << 16
#: Rows of whole groups that a task joins at once.
JOIN_AT_ONCE = 1 << 16

Rows = Iterable[pa.RecordBatch]

def remixed(h: np.ndarray) -> np.ndarray:
    """Hashes whose bits don't depend on those of h in any simple way."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def shingle_hashes(text: str, size: int, seed: int = SEED) -> np.ndarray:
    """Hashes of a text's word shingles, repeats included. Fewer words than a shingle's are one shingle; no words, none."""
    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, stops = np.concatenate([[0], ends[:-size]]), ends[size - 1 :] - 1
    hashes = np.empty(len(starts), np.uint64)
    for low in range(0, len(starts), COUNT_AT_ONCE):
        part = slice(low, low + COUNT_AT_ONCE)
        hashes[part] = [digest(joined[a:b], seed) for a, b in zip(starts[part].tolist(), stops[part].tolist(), strict=True)]
    return hashes


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = sum((bit_counts(hashes[low : low + COUNT_AT_ONCE]) for low in range(0, len(hashes), COUNT_AT_ONCE)), np.zeros(BITS, np.int64))
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, size: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text's word shingles; no words give 0."""
    return majority(shingle_hashes(text, size, seed))


def fingerprinter(size: int) -> Callable[[Rows], Iterator[pa.RecordBatch]]:
    def run(batches: Rows) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            prints = np.array([fingerprint(t, size) for t in block["text"].to_pylist()], np.uint64).view(np.int64)
            yield from block.drop_columns("text").append_column("fp", pa.array(prints)).to_batches()

    return run


def masks(n: int, budget: int) -> list[int]:
    """Bit masks of the shared blocks. More fingerprints get more blocks, thus longer shared prefixes, for groups of about GROUP."""
    agree = 1
    while n >> (BITS * agree // (budget + agree)) > GROUP:
        agree += 1
    count = budget + agree
    edges = [BITS * i // count for i in range(count + 1)]
    ranges = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(ranges, agree)]


def unite(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the sets of u and v; each label is its set's least index, and stays so."""
    while len(u):
        a, b = labels[u], labels[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        if not len(u):
            return
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := labels[labels], labels):
            labels[:] = up


def cells_of(pairs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of leaves (i < j) below node pairs (ranges a_low, a_high, b_low, b_high), CELLS at a time."""
    a_low, a_high, b_low, b_high = pairs
    width = b_high - b_low
    total = np.concatenate([[0], np.cumsum((a_high - a_low) * width)])
    for low in range(0, int(total[-1]), CELLS):
        cell = np.arange(low, min(low + CELLS, int(total[-1])))
        pair = np.searchsorted(total, cell, "right") - 1
        cell -= total[pair]
        i, j = a_low[pair] + cell // width[pair], b_low[pair] + cell % width[pair]
        ordered = i < j
        yield i[ordered], j[ordered]


def trie_pairs(words: np.ndarray, nodes: np.ndarray, budget: int, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of codes that differ in at most budget bits and whose labels differ.

    words are the codes, a row for each 64 bits; nodes are pairs of ranges to begin with (a_low, a_high, b_low, b_high),
    a range with itself or with a later one, in each of which codes rise. The labels may change between pairs: nodes
    whose codes have all one label by then need no comparison.
    """
    ones: dict[int, np.ndarray] = {}
    todo = [(BITS * len(words) - 1, np.concatenate([nodes, np.zeros((1, nodes.shape[1]), np.int64)]))]
    changes = None
    while todo:
        bit, pairs = todo.pop()
        if pairs.shape[1] > PAIRS:
            todo.append((bit, pairs[:, PAIRS:]))
            pairs = pairs[:, :PAIRS]
        if changes is None:  # counts the labels that differ from their left neighbour
            changes = np.cumsum(np.append(False, labels[1:] != labels[:-1]))
        one = (changes[pairs[0]] == changes[pairs[1] - 1]) & (changes[pairs[2]] == changes[pairs[3] - 1]) & (labels[pairs[0]] == labels[pairs[2]])
        pairs = pairs[:, ~one]
        small = ((pairs[1] - pairs[0]) * (pairs[3] - pairs[2]) <= SMALL) | (bit < 0)
        for i, j in cells_of(pairs[:4, small]):
            apart = labels[i] != labels[j]
            i, j = i[apart], j[apart]
            near = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in words) <= budget
            if near.any():
                yield i[near], j[near]
                changes = None
        pairs = pairs[:, ~small]
        if not pairs.shape[1]:
            continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((words[-1 - bit // BITS] >> np.uint64(bit % BITS)) & np.uint64(1), dtype=np.int64)])
        c = ones[bit]
        a_low, a_high, b_low, b_high, d = pairs
        a_cut, b_cut = a_high - (c[a_high] - c[a_low]), b_high - (c[b_high] - c[b_low])
        same = a_low == b_low
        children = np.concatenate([
            np.stack([a_low, a_cut, b_low, b_cut, d]), np.stack([a_cut, a_high, b_cut, b_high, d]),
            np.stack([a_low, a_cut, b_cut, b_high, d + 1]), np.stack([a_cut, a_high, b_low, b_cut, d + 1])[:, ~same],
        ], axis=1)
        children = children[:, (children[0] < children[1]) & (children[2] < children[3]) & (children[4] <= budget)]
        todo.append((bit - 1, children))


def matrix(found: pa.RecordBatch) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in found.columns])


def whole_groups(batches: Rows) -> Iterator[np.ndarray]:
    """Rows sorted by key and chunks (their first three columns) again, a row for each column, cut where these change only."""
    held, parts = None, []
    for found in batches:
        held = np.zeros((found.num_columns, 0), np.int64) if held is None else held
        parts.append(matrix(found))
        if sum(x.shape[1] for x in parts) >= JOIN_AT_ONCE:
            held, parts = np.concatenate([held, *parts], axis=1), []
            other = np.flatnonzero((held[:3] != held[:3, -1:]).any(axis=0))
            cut = other[-1] + 1 if len(other) else 0  # where the last group, which may go on, begins
            if cut:
                yield held[:, :cut]
                held = held[:, cut:]
    if held is not None and (held := np.concatenate([held, *parts], axis=1)).shape[1]:
        yield held


def roots(rows: np.ndarray) -> np.ndarray:
    """The node pairs at which the trie join of sorted rows (key, chunk, chunk, side, ...) begins.

    A group's side 0 meets its side 1, and also itself if both chunks are one.
    """
    new = (np.diff(rows[:4]) != 0).any(axis=0)
    starts = np.concatenate([[0], np.flatnonzero(new) + 1])
    ends, side = np.append(starts[1:], rows.shape[1]), rows[3, starts]
    own = (side == 0) & (rows[1, starts] == rows[2, starts]) & (ends - starts > 1)
    zero = np.flatnonzero(side[:-1] == 0)
    zero = zero[(rows[:3, starts[zero]] == rows[:3, starts[zero + 1]]).all(axis=0)]
    return np.concatenate([np.stack([starts[own], ends[own], starts[own], ends[own]]), np.stack([starts[zero], ends[zero], starts[zero + 1], ends[zero + 1]])], axis=1)


def dealt(rows: DataFrame, limit: int) -> DataFrame:
    """rows with the columns (c1, c2, side) by which tasks join them.

    rows have key, node, n (rows of the key), first and r (rows of the key that are first): the first meet each other and
    all others of their key. Up to limit rows of a key are one group. More are dealt into chunks, a group for each pair
    of chunks with first ones: so each row is in as many groups as there are chunks that it must meet.
    """

    def at(c1: Column, c2: Column, side: Column | int) -> Column:
        return F.struct(c1.cast("int").alias("c1"), c2.cast("int").alias("c2"), (F.lit(side) if isinstance(side, int) else side).cast("int").alias("side"))

    ahead, rest = F.ceil(F.col("r") / limit).cast("int"), F.ceil((F.col("n") - F.col("r")) / limit).cast("int")
    i, j = (F.pmod(F.xxhash64("node"), F.greatest(x, F.lit(1))).cast("int") for x in (ahead, rest))
    before = F.when(i > 0, F.transform(F.sequence(F.lit(0), F.greatest(i - 1, F.lit(0))), lambda c: at(c, i, 1))).otherwise(F.array().cast("array<struct<c1:int,c2:int,side:int>>"))
    meets = F.concat(F.transform(F.sequence(i, ahead + rest - 1), lambda c: at(i, c, 0)), before)
    met = F.transform(F.sequence(F.lit(0), F.greatest(ahead - 1, F.lit(0))), lambda c: at(c, ahead + j, 1))
    alone = F.array(at(F.lit(0), F.lit(0), F.when(F.col("first"), 0).otherwise(1)))
    places = F.when(F.col("n") <= limit, alone).when(F.col("first"), meets).otherwise(met)
    return rows.select("*", F.inline(places))


def tasks(rows: DataFrame) -> DataFrame:
    """Dealt rows, key and chunks in front, so that each task holds whole groups in order."""
    return rows.repartition("key", "c1", "c2").sortWithinPartitions("key", "c1", "c2", "side")


def forests(budget: int) -> Callable[[Rows], Iterator[pa.RecordBatch]]:
    """mapInArrow function over (key, c1, c2, side, node, code): a spanning forest (a > b) of the nodes that link."""

    def run(batches: Rows) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches):
            codes = rows[5].view(np.uint64)
            order = np.lexsort((codes, rows[3], rows[2], rows[1], rows[0]))
            rows, codes = rows[:, order], codes[order]
            labels = np.arange(len(codes))
            for i, j in trie_pairs(codes[None], roots(rows), budget, labels):
                unite(labels, i, j)
            linked = np.flatnonzero(labels != np.arange(len(codes)))
            if len(linked):
                x, y = rows[4, linked], rows[4, labels[linked]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])

    return run


def links(nodes: DataFrame, budget: int = BUDGET, limit: int = LIMIT) -> DataFrame:
    """Edges (a > b) between nodes (columns node, fp; fingerprints differ) that span, with others, each set linked within budget bits."""
    wanted = [m if m < 1 << 63 else m - (1 << 64) for m in masks(nodes.count(), budget)]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(wanted)])
    rows = prepared(nodes).select(F.explode(keys).alias("key"), "node", F.col("fp").alias("code"))
    crowded = durable(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit))
    sized = rows.join(beside(crowded), "key", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    placed = dealt(sized.withColumns({"first": F.lit(True), "r": F.col("n")}), limit)
    return tasks(placed.select("key", "c1", "c2", "side", "node", "code")).mapInArrow(forests(budget), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node of the edges (a > b)."""
    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = durable(edges)
    state, before = digest(edges), None
    while state != before:
        side = F.broadcast if state[0] <= BROADCAST_ROWS else durable  # minima are at most two for each edge
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = side(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = durable(edges.join(least, edges.b == least.u).select("a", F.col("m").alias("b")).distinct())
        least = side(large.groupBy("a").agg(F.min("b").alias("m")))
        joined = large.join(least, "a")
        edges = durable(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct())
        before, state = state, digest(edges)
    return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(edges.select("b", "b").distinct())


def grouped(rows: DataFrame, nodes: DataFrame, by: list[str], edges: DataFrame) -> DataFrame:
    """The rows (doc_id, row and the columns by) with component_id and kept.

    nodes have a row for each value of the columns by: node, copies (its rows) and low, the least (none, doc_id, row) of them.
    component_id is the smallest id of the rows linked to a row, directly or through others, itself included; null ids
    count only if a component has no other. Of each component one row is kept: that of the smallest id, null ids last,
    and of repeated ids the first by its key.
    """
    linked = durable(components(edges))
    member = nodes.join(beside(linked), "node", "left")
    shared = durable(member.where("root IS NOT NULL").groupBy("root").agg(F.min("low").alias("least")))
    of = member.join(beside(shared), "root", "left").withColumn("first", F.coalesce("least", "low"))
    of = durable(of.where("copies > 1 OR first <> low").select(*by, "first"))  # any other row is its own component's first
    out = rows.join(beside(of), by, "left")
    return out.select(*rows.columns, F.when(F.col("first").isNotNull(), F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce(F.col("row") == F.col("first.row"), F.lit(True)).alias("kept"))


def lowest() -> tuple[Column, Column]:
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("low"), F.count(F.lit(1)).alias("copies")


def near_groups(df: DataFrame, size: int = SHINGLE, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, row (the row's key), fp, component_id and kept of every row of df; see grouped.

    Null texts are empty texts, whose fingerprint is 0. No rows give no rows.
    """
    df, key = row_keyed(df)
    texts = keyed_texts(df, id_col, text_col, F.col(f"`{key}`").alias("row"))
    prints = durable(texts.mapInArrow(fingerprinter(size), schema_with(texts, "fp long")))
    nodes = durable(prints.groupBy("fp").agg(*lowest())).withColumn("node", F.monotonically_increasing_id())
    return grouped(prints, nodes, ["fp"], links(nodes.select("node", "fp"), budget, limit))


def shown(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", shown(F.col("fp")).alias("fingerprint"), "component_id")
