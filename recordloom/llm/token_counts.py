"""Token counts without token ids: pieces are counted once for each distinct pre-token.

No piece of the vocabulary has a space mark after another character or a line feed, so text may be cut before each
run of spaces and at each line feed, and a text's count is the sum of its pre-tokens' counts.

1. A block of documents keeps a sparse matrix of pre-token frequencies by document, and sends each owner (a hash range
   of pre-tokens) one message: its distinct pre-tokens of that range, compressed.
2. An owner counts the pieces of each distinct pre-token once and answers each message with the counts.
3. A block joins the answers to its matrix and sums.

A pre-token is in a message once for each block, so frequent words aren't hot. Blocks have bounded text. Owners are as
many as the text needs, so that what one holds is bounded: a range for each OWNER_BYTES of text, up to REGION_BYTES of
it. Beyond, blocks are dealt over regions that each have their own owners: a pre-token is counted once for each region,
and neither an owner's memory nor the number of a block's messages grows with the input.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.common import blocks, durable, keyed_texts, shuffle_partitions, table

PRE_TOKEN = re.compile(r"\n[^ \n]*| *[^ \n]+| +")
SPACE_MARK = "▁"
#: Text bytes of a block; of text for each owner; and of text that has one set of owners.
TEXT_BYTES, OWNER_BYTES, REGION_BYTES = 16 << 20, 48 << 20, 64 << 30
LIMIT = 4096


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def pieces_model(file: bytes) -> sentencepiece.SentencePieceProcessor:
    model = sentencepiece.SentencePieceProcessor(model_proto=file)
    for i in range(model.get_piece_size()):
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i):
            continue
        piece = model.id_to_piece(i)
        if SPACE_MARK in piece.lstrip(SPACE_MARK) or "\n" in piece:
            raise ValueError("pieces cross pre-tokens")
    if model.encode(" a  b ") != model.encode(f"{SPACE_MARK}a {SPACE_MARK}b ") or len(model.encode("\n")) != 2:
        raise ValueError("another normalisation than spaces to marks and a mark in front")
    return model


def pre_tokens(text: str) -> list[str]:
    """A text's pre-tokens. The mark that the library puts in front is the first one's space."""
    return PRE_TOKEN.findall(" " + text.replace(SPACE_MARK, " ")) if text else []


def piece_counts(model: sentencepiece.SentencePieceProcessor, tokens: list[str]) -> np.ndarray:
    """Pieces of each pre-token. The library puts a mark in front: it is a leading space's, or else counted off."""
    spaced = np.array([t[0] == " " for t in tokens], bool)
    encoded = model.encode([t[1:] if s else t for t, s in zip(tokens, spaced, strict=True)], num_threads=1)
    counts = np.array([len(x) for x in encoded], np.int64) - ~spaced
    counts[[i for i, t in enumerate(tokens) if t == " "]] = 1
    return counts


def packed(arrays: list[np.ndarray]) -> bytes:
    """Integer arrays, byte planes apart, compressed."""
    head = np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes()
    return zstandard.compress(head + b"".join(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays), 1)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    lengths = np.frombuffer(raw, np.int64, int(np.frombuffer(raw, np.int64, 1)[0]), 8)
    out, at = [], 8 + 8 * len(lengths)
    for n in map(int, lengths):
        planes = np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n)
        out.append(np.ascontiguousarray(planes.T).view("<u4").reshape(n).astype(np.int64))
        at += 4 * n
    return out


def strings_out(tokens: pa.Array) -> bytes:
    lengths = pa.compute.binary_length(tokens).to_numpy(zero_copy_only=False)
    raw = "".join(tokens.to_pylist()).encode()
    return zstandard.compress(np.int64(len(lengths)).tobytes() + lengths.astype("<u4").tobytes() + raw, 3)


def strings_in(data: bytes) -> pa.Array:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u4", n, 8), dtype=np.int64)])
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw[8 + 4 * n :]))


def region(block: int, regions: int) -> int:
    return (block * 0x9E3779B97F4A7C15 >> 13 & 0xFFFFFFFF) % regions


def dealt(size: int, least: int) -> tuple[int, int]:
    """Owners of a region, and regions, for so many bytes of text."""
    return max(1, min(least, REGION_BYTES // OWNER_BYTES), -(-min(size, REGION_BYTES) // OWNER_BYTES)), max(1, -(-size // REGION_BYTES))


def block_rows(owners: int, regions: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    message = pa.list_(pa.struct([("owner", pa.int32()), ("tokens", pa.binary())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for block in blocks(batches, limit=TEXT_BYTES):
            found = [pre_tokens(t) for t in block["text"].to_pylist()]
            lengths = np.array([len(x) for x in found])
            coded = pa.array([t for x in found for t in x], pa.string()).dictionary_encode()
            del found
            vocabulary = coded.dictionary
            owner = pd.util.hash_array(np.array(vocabulary.to_pylist(), object), categorize=False) % np.uint64(owners) if len(vocabulary) else np.zeros(0, np.uint64)
            order = np.argsort(owner, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            key = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths) * max(1, len(order)) + place[coded.indices.to_numpy(zero_copy_only=False)] if len(order) else np.zeros(0, np.int64)
            key, times = np.unique(key, return_counts=True)
            docs, columns = np.divmod(key, max(1, len(order)))
            sizes = np.bincount(docs, minlength=len(lengths))
            step = np.diff(columns, prepend=0)
            first = np.cumsum(sizes) - sizes
            starts = first[sizes > 0]
            step[starts] = columns[starts]  # columns rise within a document
            vocabulary, by = vocabulary.take(pa.array(order)), owner[order].astype(np.int64)
            cuts = np.flatnonzero(np.diff(by, prepend=-1))
            sent = [{"owner": int(by[a]), "tokens": strings_out(vocabulary.slice(a, b - a))} for a, b in zip(cuts, [*cuts[1:], len(by)], strict=True)] if len(by) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([region(number, regions)], pa.int32()), pa.array([block["doc_id"].to_pylist()], pa.list_(block["doc_id"].type)), pa.array([pa.compute.binary_length(block["text"]).to_pylist()], pa.list_(pa.int64())), pa.array([packed([sizes, step, times])], pa.binary()), pa.array([sent], message)],
                names=["block", "region", "doc_ids", "n_bytes", "matrix", "messages"],
            )
            number += 1

    return run


def counted(sent) -> Callable[[pd.DataFrame], pd.DataFrame]:  # noqa: ANN001
    """An owner's answers: each of its distinct pre-tokens is counted once."""

    def run(got: pd.DataFrame) -> pd.DataFrame:
        lists = [strings_in(x) for x in got["tokens"]]
        coded = pa.chunked_array(lists).combine_chunks().dictionary_encode()
        counts = piece_counts(pieces_model(sent.value), coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        answers = np.split(counts, np.cumsum([len(x) for x in lists])[:-1])
        return pd.DataFrame({"block": got["block"], "owner": got["owner"], "counts": [packed([x]) for x in answers]})

    return run


def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            sizes, step, times = unpacked(row.column("matrix")[0].as_py())
            answers = sorted(row.column("answers")[0].as_py() or [], key=lambda x: x["owner"])
            counts = np.concatenate([np.zeros(0, np.int64), *(unpacked(x["counts"])[0] for x in answers)])
            total = np.cumsum(step)
            first = np.cumsum(sizes) - sizes
            base = np.where(first > 0, total[np.maximum(first, 1) - 1], 0) if len(total) else np.zeros(len(sizes), np.int64)
            columns = total - np.repeat(base, sizes)
            tokens = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=times * counts[columns], minlength=len(sizes)).astype(np.int64) if len(columns) else np.zeros(len(sizes), np.int64)
            yield pa.RecordBatch.from_arrays([row.column("doc_ids").flatten(), row.column("n_bytes").flatten(), pa.array(tokens)], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(df: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row's whole text.

    Counts are those of the sentencepiece library for the file. Null and empty texts have 0 tokens; repeated rows give
    repeated rows; null ids stay null; an empty table gives no rows.
    """
    spark = df.sparkSession
    texts = keyed_texts(df, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    sent = spark.sparkContext.broadcast(Path(path or default_path()).read_bytes())
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    owners, regions = dealt(size, shuffle_partitions(spark))
    rows = durable(texts.mapInArrow(block_rows(owners, regions), f"block long, region int, doc_ids array<{kind}>, n_bytes array<long>, matrix binary, messages array<struct<owner:int,tokens:binary>>"))
    asked = rows.select("block", "region", F.inline("messages"))
    answers = asked.groupBy("region", "owner").applyInPandas(counted(sent), "block long, owner int, counts binary")
    back = answers.groupBy("block").agg(F.collect_list(F.struct("owner", "counts")).alias("answers"))
    whole = rows.select("block", "doc_ids", "n_bytes", "matrix").join(back, "block", "left").select("doc_ids", "n_bytes", "matrix", "answers")
    return whole.mapInArrow(summed, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op10_pre_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
