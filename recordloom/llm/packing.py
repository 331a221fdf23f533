"""Best-fit packing of token sequences with bounded space.

Documents become pieces of at most `capacity` tokens. Each task packs the pieces it reads online: a piece goes to the
open bin with the least free space that holds it; if none does, a new bin opens, and at `max_open` open bins the
fullest closes first. Open bins are keyed by free space in a bitset, so best fit is a lowest set bit.

Bins that end part-filled are packed once more, whole, as items of their load, by tasks that each take many of them; so what a task leaves part-filled doesn't add up over tasks. Memory is max_open bins whatever the
input; texts and ids don't move.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recordloom.llm.bpe import byte_of_char
from recordloom.llm.common import blocks, durable, keyed_texts, prepared, table

CAPACITY, MAX_OPEN, END_ID = 4096, 512, 1
#: Text bytes that are encoded at once.
TEXT_BYTES = 3 << 20
#: Left-over bins that one task of the second pass packs.
LEFTOVERS = 1 << 16


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts under a tokenizer file of BPE with word ends, which drops white space.

    White space always separates, so texts are cut at ASCII white space and each distinct chunk of a block is encoded
    once: chunks of common letters by a rank-based engine, in which byte 0 stands for the word-end mark, all others by
    the tokenizers library itself.
    """

    END = b"\x00"

    def __init__(self, file: bytes) -> None:
        spec = json.loads(file)
        splits, kinds = spec["pre_tokenizer"]["pretokenizers"][0], [n["type"] for n in spec["normalizer"]["normalizers"]]
        suffix = spec["model"]["end_of_word_suffix"]
        if kinds != ["NFC", "Replace", "Lowercase"] or splits["behavior"] != "Removed" or not suffix or any(re.search(r"\s", t["content"]) or not t["content"].startswith("<|") for t in spec["added_tokens"]):
            raise ValueError("not a lower-casing word BPE")
        self.library = Tokenizer.from_str(file.decode())
        self.words = regex.compile(splits["pattern"]["Regex"])
        back, ranks = byte_of_char(), {}
        for token, i in spec["model"]["vocab"].items():
            body = token.removesuffix(suffix)
            if all(c in back for c in body):
                ranks[bytes(back[c] for c in body) + self.END * (body != token)] = i
        self.core = tiktoken.Encoding("word_bpe", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(ranks.values()) + 1, bool)
        self.ends[[i for b, i in ranks.items() if len(b) > 1 and b.endswith(self.END)]] = True
        #: Printable ASCII and Latin letters and signs that NFC leaves alone and that lower-case one to one.
        self.common = re.compile("[!-~¡-¬®-įı-ſ]+")

    def chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, one after another, and how many each has."""
        ids: list[np.ndarray] = []
        counts = np.zeros(len(chunks), np.int64)
        plain, words, per = [], [], []
        rest = []
        for i, c in enumerate(chunks):
            if self.common.fullmatch(c) and "<|" not in c:
                w = [c.lower()] if c.isalpha() else self.words.findall(c.lower())
                plain.append(i)
                per.append(len(w))
                words += w
            else:
                rest.append(i)
        if plain:
            raw = self.core.encode_to_numpy("\x00".join(words) + "\x00", disallowed_special=())
            ends = np.flatnonzero(self.ends[raw]) + 1
            if len(ends) != len(words):
                raise AssertionError("word ends were lost")
            bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per)])]
            counts[plain] = np.diff(bounds)
            ids.append(raw)
        for k in range(0, len(rest), 1000):
            part = rest[k : k + 1000]
            got = [e.ids for e in self.library.encode_batch([chunks[i] for i in part], add_special_tokens=False)]
            counts[part] = [len(x) for x in got]
            ids += [np.array(x, np.uint32) for x in got]
        order = np.array(plain + rest, np.int64)
        if not len(order):
            return np.zeros(0, np.uint32), counts
        flat, sizes = np.concatenate(ids).astype(np.uint32), counts[order]
        starts = np.empty(len(chunks), np.int64)
        starts[order] = np.cumsum(sizes) - sizes
        return gathered(flat, starts, counts), counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        parts = [t.encode().split() for t in texts]
        lengths = np.array([len(p) for p in parts], np.int64)
        coded = pa.array([c for p in parts for c in p], pa.binary()).dictionary_encode()
        ids, counts = self.chunks([c.decode() for c in coded.dictionary.to_pylist()])
        which = coded.indices.to_numpy(zero_copy_only=False)
        starts = np.cumsum(counts) - counts
        sizes = np.concatenate([[0], np.cumsum(counts[which])]) if len(which) else np.zeros(1, np.int64)
        bounds = sizes[np.concatenate([[0], np.cumsum(lengths)])]
        return gathered(ids, starts[which], counts[which]) if len(which) else ids, np.diff(bounds)


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size], one after another."""
    total = int(sizes.sum())
    at = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    return flat[at]


@lru_cache(maxsize=2)
def word_encoder(file: bytes) -> WordEncoder:
    return WordEncoder(file)


class OpenBins:
    """Best fit over a bounded number of open bins, keyed by free space in a bitset."""

    def __init__(self, capacity: int, max_open: int, first: int) -> None:
        self.capacity, self.max_open, self.next = capacity, max_open, first
        self.bits, self.open = 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def take(self, free: int) -> int:
        found = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def put(self, size: int) -> tuple[int, int]:
        """Bin and offset of an item."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            number = self.take(free)
        else:
            if self.open >= self.max_open:
                self.take((self.bits & -self.bits).bit_length() - 1)
            number, free = self.next, self.capacity
            self.next += 1
        left = free - size
        if left:
            self.bins[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - free


def piece_rows(sent, capacity: int, end_id: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_encoder(sent.value)
        for block in blocks(batches, limit=TEXT_BYTES):
            ids, counts = coder.encode(block["text"].to_pylist())
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id).astype("<u4")
            sizes = counts + 1
            parts = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), parts)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = number * capacity
            length = np.minimum(capacity, sizes[doc] - start)
            base = (np.cumsum(sizes) - sizes)[doc] + start
            raw = ids.tobytes()
            out = pa.table({"doc_id": block["doc_id"].combine_chunks().take(pa.array(doc)), "piece": pa.array(number, pa.int32()), "start": start, "length": length, "ids": pa.array([raw[4 * a : 4 * (a + n)] for a, n in zip(base.tolist(), length.tolist(), strict=True)], pa.binary())})
            yield from out.to_batches(max_chunksize=1000)

    return run


def pieces(df: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every row's tokens and its end id."""
    texts = keyed_texts(df, id_col, text_col)
    sent = df.sparkSession.sparkContext.broadcast(Path(path or default_path()).read_bytes())
    return texts.mapInArrow(piece_rows(sent, capacity, end_id), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids binary")


def placer(capacity: int, max_open: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function: rows with `length` get bin and offset."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(capacity, max_open, TaskContext.get().partitionId() << 40)
        for batch in batches:
            placed = [bins.put(n) for n in batch.column("length").to_pylist()]
            if placed:
                number, offset = zip(*placed, strict=True)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number, pa.int64()), pa.array(offset, pa.int64())], names=[*batch.schema.names, "bin", "offset"])

    return run


def packed(rows: DataFrame, capacity: int = CAPACITY, max_open: int = MAX_OPEN) -> DataFrame:
    """Rows with `length` (1 to capacity) get sequence_id and offset.

    Sequences hold at most capacity; a row's offset is the sum of the lengths before it there, so offsets are gapless
    from 0. Equal and repeated rows are items like others; no rows give no rows.
    """
    spark = rows.sparkSession
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    first = durable(prepared(rows).mapInArrow(placer(capacity, max_open), f"{fields}, bin long, offset long"))
    loads = durable(first.groupBy("bin").agg(F.sum("length").alias("length")).where(F.col("length") < capacity))
    n = loads.count()
    again = loads.select(F.col("bin").alias("old"), "length").repartition(max(1, -(-n // LEFTOVERS)), "old")
    moved = durable(again.mapInArrow(placer(capacity, max_open), "old long, length long, bin long, offset long"))
    moved = moved.select(F.col("old").alias("bin"), (-1 - F.col("bin")).alias("sequence"), F.col("offset").alias("base"))
    both = first.join(moved, "bin", "left")
    return both.select(*rows.columns, F.coalesce("sequence", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))


def packed_documents(df: DataFrame, path: str | None = None, capacity: int = CAPACITY, max_open: int = MAX_OPEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows' tokens packed into sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and the end id; only documents longer than capacity are cut. Null and empty texts are the
    end id alone; repeated rows are packed each; null ids stay null; an empty table gives no rows.
    """
    # Kept before it is packed, so that no task needs a tokenizing and a packing worker at once.
    narrow = durable(pieces(df, path, capacity, END_ID, id_col, text_col).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packed(narrow, capacity, max_open)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
