"""Byte-level BPE encoding and decoding with tree concatenation of long unsplit text.

Pre-tokenisation splits most text into short pieces, which the merge engine encodes at once. A piece that it can't
split (a long run without a boundary) is halved down to leaves; leaves are encoded in parallel, by threads whose merge
engine runs without the interpreter's lock; and halves are joined up the tree: a window of tokens around the join is encoded again and grows until its first token is the left half's
own and its last token the right half's own. As BPE output is right exactly if all neighbouring tokens are right as a
pair, the joined tokens are then those of the whole piece, exactly.

Every document is encoded in the task that reads it: nothing is shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recordloom.llm.common import blocks, keyed_texts, prepared, table

#: Pieces of at least this many characters are encoded by tree concatenation, from leaves of at most LEAF characters.
LONG_PIECE, LEAF = 4096, 2048
THREADS = 2


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of one tokenizer file of byte-level BPE without a normaliser."""

    def __init__(self, file: bytes) -> None:
        spec = json.loads(file)
        if spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("not a plain byte-level tokenizer")
        back = byte_of_char()
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in back for c in token)}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s in self.specials:
            ranks.pop(s.encode(), None)
        import public_tokenizers

        self.core = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.unsplit = tiktoken.Encoding("unsplit", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.split = Tokenizer.from_str(file.decode()).pre_tokenizer.pre_tokenize_str
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.long = re.compile(rf"\S{{{LONG_PIECE - 1}}}|\s{{{LONG_PIECE - 1}}}")
        self.pool = ThreadPoolExecutor(THREADS)

    def single(self, piece: bytes) -> list[int]:
        return self.core._core_bpe.encode_single_piece(piece)

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        width, size = 4, self.core.decode_bytes
        while True:
            a, b = left[-width:], right[:width]
            window = self.single(size(a) + size(b))
            if (len(a) == len(left) or window[0] == a[0]) and (len(b) == len(right) or window[-1] == b[-1]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            width *= 2

    def tree(self, piece: str, leaf: int = LEAF) -> list[int]:
        """Tokens of one unsplit piece."""
        cuts = [0, len(piece)]
        while max(b - a for a, b in zip(cuts, cuts[1:], strict=False)) > leaf:
            cuts = sorted({*cuts, *((a + b) // 2 for a, b in zip(cuts, cuts[1:], strict=False))})
        parts = list(self.pool.map(self.unsplit, (piece[a:b] for a, b in zip(cuts, cuts[1:], strict=False))))
        while len(parts) > 1:
            pairs = [parts[i : i + 2] for i in range(0, len(parts), 2)]
            parts = [self.joined(*p) if len(p) == 2 else p[0] for p in pairs]
        return parts[0]

    def plain(self, text: str) -> list[int]:
        if not self.long.search(text):
            return self.core.encode_ordinary(text)
        out: list[int] = []
        for _, (start, end) in self.split(text):
            out += self.tree(text[start:end]) if end - start >= LONG_PIECE else self.single(text[start:end].encode())
        return out

    def encode(self, text: str) -> list[int]:
        if not self.special or "<" not in text:
            return self.plain(text) if text else []
        out: list[int] = []
        for part in self.special.split(text):
            out += [self.specials[part]] if part in self.specials else self.plain(part) if part else []
        return out

    def decode(self, ids: list[int]) -> str:
        back = {i: s.encode() for s, i in self.specials.items()}
        if not any(i in back for i in set(ids)):
            return self.core.decode_bytes(ids).decode(errors="replace")
        return b"".join(back.get(i) or self.core.decode_bytes([i]) for i in ids).decode(errors="replace")


@lru_cache(maxsize=2)
def codec(file: bytes) -> Codec:
    return Codec(file)


def encoder(sent) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(sent.value).encode
        for block in blocks(batches):
            ids = [np.array(encode(t), "<u4") for t in block["text"].to_pylist()]
            out = pa.table({"doc_id": block["doc_id"], "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids": pa.array([x.tobytes() for x in ids], pa.binary())})
            yield from out.to_batches()

    return run


def decoder(sent) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(sent.value).decode
        for block in blocks(batches, "ids"):
            texts = [None if x is None else decode(np.frombuffer(x, "<u4").tolist()) for x in block["ids"].to_pylist()]
            yield from block.append_column("decoded", pa.array(texts, pa.string())).to_batches()

    return run


def encoded(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every row's whole text.

    Ids are those of the tokenizers library for the file, special strings inside a text included, without added
    special tokens. Null and empty texts give no ids; repeated rows give repeated rows; null ids stay null.
    """
    texts = keyed_texts(df, id_col, text_col)
    sent = df.sparkSession.sparkContext.broadcast(Path(path or default_path()).read_bytes())
    return texts.mapInArrow(encoder(sent), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def decoded(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of encoded() with `decoded`, the text of their ids; null ids columns give null texts."""
    sent = df.sparkSession.sparkContext.broadcast(Path(path or default_path()).read_bytes())
    rows = prepared(df.select("doc_id", "n_tokens", "ids"))
    return rows.mapInArrow(decoder(sent), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, decoded string")


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decoded(encoded(table(spark, sf_dir, "documents")))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
