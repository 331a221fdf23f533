"""Language identification by rank-order profiles.

A profile lists a language's most frequent n-grams (one to three letters within words, a blank marking word edges) by
rank. A document's own most frequent n-grams are compared to each profile by out-of-place distance: the sum over its
n-grams of how far their ranks lie apart, or of the largest distance for those that the profile lacks.

Profiles are fitted on a bounded sample of labelled rows (TRAIN_DOCS for each language, chosen by a hash of the id);
predictions cover every row's whole text in the task that reads it. Only (language, n-gram, count) rows are shuffled,
and only the profiles are broadcast: PROFILE n-grams for each language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.llm.common import blocks, prepared, table, text_or_empty

PROFILE = 300
#: Labelled rows of each language that profiles are fitted on, as expected of a hash threshold.
TRAIN_DOCS = 2000
UNKNOWN = "und"
BLANK = 1
HASH_RANGE = 1 << 30
#: Code points whose n-grams are counted at once.
PART = 1 << 20

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a text's n-grams, rising, and their counts. 21 bits a letter; none for a text without letters.

    A long text is counted part by part, so that memory is bounded; parts end at spaces, over which no n-gram reaches.
    """
    found, at = [], 0
    while at < len(text):
        end = text.find(" ", at + PART) if len(text) - at > PART else -1
        end = len(text) if end < 0 else end
        found.append(part_grams(text[at:end]))
        if len(found) > 16:
            found = [summed(found)]
        at = end
    return found[0] if len(found) == 1 else summed(found)


def summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes, inverse = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    return codes, np.bincount(inverse, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64)


def part_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    chars = np.concatenate([[BLANK], np.where(letters()[points], points, BLANK), [BLANK]]).astype(np.uint64)
    chars = chars[np.append(True, (chars[1:] != BLANK) | (chars[:-1] != BLANK))]
    two = chars[:-1] | chars[1:] << np.uint64(21)
    if len(chars) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    three = (two[:-1] | chars[2:] << np.uint64(42))[chars[1:-1] != BLANK]
    return np.unique(np.concatenate([chars[chars != BLANK], two, three]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes, most frequent first, ties to the smaller code."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        pool = np.flatnonzero(counts >= least)
        codes, counts = codes[pool], counts[pool]
    return codes[np.lexsort((codes, -counts))[:size]]


class Profiles:
    """Rank-order profiles of some languages."""

    def __init__(self, by_lang: dict[str, list[int]]) -> None:
        self.langs = sorted(by_lang)
        self.codes = np.unique(np.array([c for p in by_lang.values() for c in p], np.uint64))
        self.size = max([1, *map(len, by_lang.values())])
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, np.array(by_lang[lang], np.uint64)), j] = np.arange(len(by_lang[lang]))

    def predict(self, text: str) -> tuple[str, float]:
        """Language of the least out-of-place distance (ties: the first by name) and 1 - distance / its maximum."""
        own = ranked(*grams(text))
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, own)
        known = self.codes[np.minimum(at, len(self.codes) - 1)] == own
        found = self.ranks[np.where(known, at, len(self.codes))]
        worst = max(self.size, PROFILE)
        apart = np.where(found >= 0, np.abs(found - np.arange(len(own))[:, None]), worst).sum(axis=0)
        best = int(np.argmin(apart))
        return self.langs[best], float(1 - apart[best] / (worst * len(own)))


def counter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of each block of labelled texts."""
    for block in blocks(batches):
        sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for lang, text in zip(block["lang"].to_pylist(), block["text"].to_pylist(), strict=True):
            sums.setdefault(lang, []).append(grams(text))
        for lang, found in sums.items():
            codes, n = summed(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def fit(df: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Profiles:
    """Profiles from rows that are usable and have a language: about train_docs for each, by a hash of the id, or all if fewer."""
    lang = F.col(f"`{lang_col}`").cast("string")
    labelled = prepared(df.where(usable & lang.isNotNull()).select(F.col(f"`{id_col}`").cast("string").alias("id"), text_or_empty(text_col).alias("text"), lang.alias("lang")))
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    share = F.least(F.lit(1.0), F.lit(float(train_docs)) / F.col("rows")) * HASH_RANGE
    sample = labelled.join(F.broadcast(counts), "lang").where(F.pmod(F.xxhash64("id"), F.lit(HASH_RANGE)) < share)  # a row for each language
    sums = sample.select("lang", "text").mapInArrow(counter, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE).collect()
    found: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        found.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(found)


def predictor(sent, names: tuple[str, str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = sent.value
        for block in blocks(batches):
            lang, score = zip(*map(profiles.predict, block["text"].fill_null("").to_pylist()), strict=True)
            yield from block.append_column(names[0], pa.array(lang, pa.string())).append_column(names[1], pa.array(score, pa.float64())).to_batches()

    return run


def predicted(df: DataFrame, profiles: Profiles, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The rows of df (with a string column text) with the predicted language and its score, in columns of these names."""
    sent = df.sparkSession.sparkContext.broadcast(profiles)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return prepared(df).mapInArrow(predictor(sent, names), f"{fields}, {names[0]} string, {names[1]} double")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from training; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of df.

    Profiles come from text and language of rows that aren't held out. Null texts and texts without a letter are
    `und` with score 0, as is any text where no row has a language; repeated rows get the same result.
    """
    profiles = fit(df, ~held_out(id_col), id_col, text_col, lang_col, train_docs)
    texts = df.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(id_col).alias("held_out"), text_or_empty(text_col).alias("text"))
    return predicted(texts, profiles).select("doc_id", "held_out", "lang_pred", "score")


def op2_rank_order_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))
