"""Near-duplicates by SimHash with an exact check: texts whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

1. Each text's distinct shingles give a SimHash of 128 bits, and BANDS keys by which texts meet: a key is the least
   shingle under two random orders. Two sets of similarity s share a key with a chance of 1 - (1 - s^2)^BANDS: at 0.8
   all but four in 100,000 meet, and the number of keys doesn't grow with the input.
2. Texts that share a key are joined by the binary trie self-join of simhash.py, with an error budget of BUDGET of 128
   bits. Sets of similarity 0.8 differ in 19 bits on average, with a deviation of 4, so none is likely to be lost.
3. An exact check follows, whose first steps are cheap bounds: sizes, then bitmaps of about a bit for each shingle, in
   which each shingle flips one bit, so that two sets differ in at least as many shingles as their bitmaps in bits. What
   is left is decided by the sets themselves (shingles count as equal if their 64-bit hashes are).

Texts of equal sets are one node. Copies in a large group would meet in all pairs: so first each text meets only a few
of those that share a key with it, the pivots, and then only texts that this left in different components meet.
Keys that many texts share are dealt over tasks in chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import beside, blocks, durable, keyed_texts, row_keyed, schema_with
from recordloom.llm.simhash import BITS, LIMIT, Rows, components, dealt, grouped, lowest, majority, remixed, roots, shingle_hashes, tasks, trie_pairs, whole_groups

#: Sets link at a similarity of PART / WHOLE or more.
PART, WHOLE = 4, 5
#: Differing bits of 128 at which texts still meet, and keys of two least shingles each by which they do.
BUDGET, BANDS = 44, 10
#: Each salt has its own pivot for each key.
SALTS = (0x51, 0xA7, 0xF3)
#: Longs of the bitmaps that tasks compare before they report a pair; long texts need the longer ones, compared after.
FIXED = 8
#: Rows of a key that a task joins with the key's pivots, which are few enough to be in many tasks.
CHUNK = 1 << 10
#: Shingles that are ordered at once.
AT_ONCE = 1 << 13
ORDERS = remixed(np.arange(1, 2 * BANDS + 1, dtype=np.uint64))


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles. Fewer words than a shingle's are one shingle, as are none."""
    found = np.unique(shingle_hashes(text, size).view(np.int64))
    return found if len(found) else np.zeros(1, np.int64)


def keys_of(found: np.ndarray) -> np.ndarray:
    """BANDS keys of a set, each of its least shingles under two orders."""
    hashes, least = found.view(np.uint64), np.full(2 * BANDS, np.iinfo(np.uint64).max)
    for low in range(0, len(hashes), AT_ONCE):
        least = np.minimum(least, remixed(hashes[low : low + AT_ONCE] ^ ORDERS[:, None]).min(axis=1))
    return remixed(remixed(least[::2] ^ ORDERS[::2]) ^ least[1::2]).view(np.int64)


def bitmap(found: np.ndarray, longs: int = 0) -> np.ndarray:
    """A bitmap of a power of two of longs, a bit or more for each shingle, in which each shingle flips a bit."""
    longs = longs or 1 << max(0, (len(found) - 1) // BITS).bit_length()
    flips = np.bincount(found.view(np.uint64) % np.uint64(BITS * longs), minlength=BITS * longs) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view("<i8")


def lists(found: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), pa.array(np.concatenate(found)))


MARKS = "d1 long, d2 long, n long, fp long, fp2 long, fixed array<long>, bits array<long>, keys array<long>"


def marked(size: int) -> Callable[[Rows], Iterator[pa.RecordBatch]]:
    """mapInArrow function: a digest of each text's shingle set, its size, SimHash, bitmaps and keys."""

    def run(batches: Rows) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            narrow, fixed, bits, keys = [], [], [], []
            for text in block["text"].to_pylist():
                found = shingles(text, size)
                hashes = found.view(np.uint64)
                prints = np.array([majority(hashes), majority(remixed(hashes))], np.uint64).view(np.int64)
                narrow.append([*np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), "<i8"), len(found), *prints])
                fixed.append(bitmap(found, FIXED))
                bits.append(bitmap(found))
                keys.append(keys_of(found))
            columns = [*(pa.array(c) for c in np.array(narrow, np.int64).T), lists(fixed), lists(bits), lists(keys)]
            out = block.drop_columns("text")
            for name, column in zip(("d1", "d2", "n", "fp", "fp2", "fixed", "bits", "keys"), columns, strict=True):
                out = out.append_column(name, column)
            yield from out.to_batches()

    return run


def sets_of(size: int) -> Callable[[Rows], Iterator[pa.RecordBatch]]:
    def run(batches: Rows) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = lists([shingles(t, size) for t in block["text"].to_pylist()])
            yield from block.drop_columns("text").append_column("hashes", found).to_batches()

    return run


def candidates(budget: int) -> Callable[[Rows], Iterator[pa.RecordBatch]]:
    """mapInArrow function over (key, c1, c2, side, node, label, size, fp, fp2, fixed bitmap): pairs (a > b) that may link.

    They come by the trie join, at most budget bits apart, with different labels, and have sizes and bitmaps that allow a link.
    """

    def run(batches: Rows) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches):
            words = rows[7:9].view(np.uint64)
            order = np.lexsort((words[1], words[0], rows[3], rows[2], rows[1], rows[0]))
            rows, words = rows[:, order], words[:, order]
            node, label, size, maps = rows[4], rows[5], rows[6], rows[9:].view(np.uint64)
            for i, j in trie_pairs(words, roots(rows), budget, label):
                n, m = size[i], size[j]
                ok = WHOLE * np.minimum(n, m) >= PART * np.maximum(n, m)
                i, j = i[ok], j[ok]
                apart = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in maps)
                ok = (PART + WHOLE) * apart <= (WHOLE - PART) * (size[i] + size[j])
                x, y = node[i[ok]], node[j[ok]]
                if len(x):
                    a, b = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def folded(bits: Column, longs: Column) -> Column:
    """A bitmap of so many longs from one of as many or of twice as many, in whose halves a shingle flips the same place."""
    half = F.zip_with(F.slice(bits, F.lit(1), longs), F.slice(bits, longs + 1, longs), lambda a, b: a.bitwiseXOR(b))
    return F.when(F.size(bits) > longs, half).otherwise(bits)


def linked(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The pairs (a > b) of nodes whose sets have the similarity wanted, by their bitmaps and then by their sets."""
    maps = nodes.select("node", "n", "bits")
    both = pairs.distinct().join(maps.toDF("a", "n", "x"), "a").join(maps.toDF("b", "m", "y"), "b")
    longs = F.least(F.size("x"), F.size("y"))
    apart = F.aggregate(F.zip_with(folded(F.col("x"), longs), folded(F.col("y"), longs), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    pairs = durable(both.where((PART + WHOLE) * apart <= (WHOLE - PART) * (F.col("n") + F.col("m"))).select("a", "b"))
    needed = durable(nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node").select("node", F.col("low.row").alias("row")))
    sets = durable(texts.join(beside(needed), "row").select("node", "text").mapInArrow(sets_of(size), "node long, hashes array<long>"))
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return durable(both.where((PART + WHOLE) * F.size(F.array_intersect("x", "y")) >= PART * (F.size("x") + F.size("y"))).select("a", "b"))


def links(texts: DataFrame, nodes: DataFrame, size: int, limit: int = LIMIT) -> DataFrame:
    """Edges (a > b) between nodes (sets) that with others span each component; texts have the row of each."""
    keys = nodes.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    pivots = [F.min(F.struct(F.xxhash64("node", F.lit(s)).alias("h"), "node")).getField("node") for s in SALTS]
    shared = durable(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.array(*pivots)).alias("pivots")).where("n > 1"))
    prints = nodes.select("node", F.col("n").alias("size"), "fp", "fp2", *[F.col("fixed")[i].alias(f"w{i}") for i in range(FIXED)])
    meeting = durable(keys.join(beside(shared), "key").join(prints, "node"))
    columns = ["key", "c1", "c2", "side", "node", "label", "size", "fp", "fp2", *(f"w{i}" for i in range(FIXED))]

    def joined(rows: DataFrame, most: int) -> DataFrame:
        return linked(tasks(dealt(rows, most).select(*columns)).mapInArrow(candidates(BUDGET), "a long, b long"), nodes, texts, size)

    first = F.array_contains("pivots", F.col("node"))
    few = joined(meeting.withColumns({"label": F.col("node"), "first": first, "r": F.size("pivots").cast("long")}), min(limit, CHUNK))
    known = durable(components(few)).withColumnRenamed("node", "known")
    labelled = meeting.drop("n", "pivots").join(beside(known), F.col("node") == F.col("known"), "left").withColumn("label", F.coalesce("root", "node"))
    counts = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"))
    split = durable(counts.where("n > top.n"))
    rest = labelled.join(beside(split), "key").withColumns({"first": F.col("label") != F.col("top.label"), "r": F.col("n") - F.col("top.n")})
    return few.union(joined(rest, limit))


def near_groups(df: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text", key: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, row (the row's key), component_id and kept of every row of df; see simhash.grouped.

    Null texts are empty texts. No rows give no rows. The key's column may be given where df has one from row_keyed.
    """
    if key is None:
        df, key = row_keyed(df)
    texts = keyed_texts(df, id_col, text_col, F.col(f"`{key}`").alias("row"))
    marks = durable(texts.mapInArrow(marked(size), schema_with(texts, MARKS)))
    one = F.any_value(F.struct("n", "fp", "fp2", "fixed", "bits", "keys")).alias("one")
    nodes = durable(marks.groupBy("d1", "d2").agg(*lowest(), one).select("d1", "d2", "low", "copies", "one.*")).withColumn("node", F.monotonically_increasing_id())
    return grouped(marks.select("doc_id", "row", "d1", "d2"), nodes.select("d1", "d2", "low", "copies", "node"), ["d1", "d2"], links(texts.select("row", "text"), nodes, size, limit)).drop("d1", "d2")
