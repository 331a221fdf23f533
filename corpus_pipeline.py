"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

1. language ID drops documents whose language isn't known (no letters, or like no learned language);
2. exact de-duplication keeps the row of the largest id of equal texts;
3. near-de-duplication keeps one document of each group linked by a Jaccard similarity of 0.8 or more: the SimHash trie
   join finds the pairs, and each is checked exactly;
4. personal data is replaced by its kind;
5. the documents left are packed into token sequences.

All stages but the last return the columns of documents. Null ids and repeated rows pass through like others; null
texts have no language and go in the first stage; empty tables give empty tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import exact_dedup, langid, packing, pii, similarity
from recordloom.llm.common import free_name, removed, row_keyed, shared_folder, table, without_rows

#: Texts that score below this are like no learned language; clean texts of the learned ones score above 0.35.
MIN_SCORE = 0.25
#: Words of a shingle.
NEAR_WORDS = 5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    profiles = langid.fit(docs, ~langid.held_out())
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    found = langid.predicted(docs, profiles, (lang, score))
    return found.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= MIN_SCORE)).drop(lang, score)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed, key = row_keyed(docs)
    return without_rows(keyed, key, exact_dedup.groups(keyed, key=key).where("NOT kept").select("row"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed, key = row_keyed(docs)
    return without_rows(keyed, key, similarity.near_groups(keyed, NEAR_WORDS, key=key).where("NOT kept").select("row"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("pii_redaction", personal_data),
    ("best_fit_packing", pack),
]

#: Fingerprints, trained models and tokenizers aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; what each returns is written to the shared folder and read again.

    Each table goes once the next stage has used it.
    """
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        for before, _ in STAGES:
            if before != name:
                removed(spark, f"{folder}/{before}")
    return docs
