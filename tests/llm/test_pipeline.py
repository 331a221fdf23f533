import os
from collections import Counter

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from recordloom.llm import common, exact_dedup, packing
from tests.llm import cases


def steps(spark, docs, tmp_path):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, None).write.parquet(str(tmp_path / name))
        columns, docs = docs.columns, spark.read.parquet(str(tmp_path / name))
        out.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    return out


def written(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "documents"))
    return spark.read.parquet(str(tmp_path / "documents"))


def test_hard_rows(spark, tmp_path):
    docs = cases.documents(spark).withColumnRenamed("h", "text_sha256")
    language, exact, near, private, packed = steps(spark, written(spark, docs, tmp_path), tmp_path)
    assert {r.text for r in language.collect()}.isdisjoint({None, "", " ", "\n\t ", "1234567890" * 30})
    kept = Counter(r.text for r in exact.collect())
    assert set(kept.values()) == {1} and set(kept) == {r.text for r in language.collect()}
    assert 6 in {r.doc_id for r in exact.collect()}
    assert near.count() <= exact.count() and private.count() == near.count()
    assert "<EMAIL>" in "".join(r.text for r in private.collect())
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in private.collect()}


def test_empty_table(spark, tmp_path):
    assert [d.count() for d in steps(spark, written(spark, cases.empty(spark), tmp_path), tmp_path)] == [0] * 5


def test_run_is_its_stages(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    last = steps(spark, docs, tmp_path)[-1].collect()
    folder = common.shared_folder(spark).removeprefix("file:")
    known = set(os.listdir(folder))
    got = corpus_pipeline.run(spark, tiny).collect()
    made = [f for f in set(os.listdir(folder)) - known if f.startswith("pipeline-")]
    assert [os.listdir(f"{folder}/{f}") for f in made] == [["best_fit_packing"]]  # tables between stages go
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in got) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in last)
    assert packing.CAPACITY >= max(r.offset + r.length for r in got)


def test_rows_are_dropped_by_what_they_are(spark, tmp_path):
    """Other splits between a stage's scans, and columns with the names that stages use, change nothing."""
    docs = cases.hot(spark, 3000).selectExpr("*", "'mine' AS row", "1 AS lang_pred", "2 AS score", "3 AS __lang", "4 AS __row")
    docs = docs.repartition(7)
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    keyed, key = common.row_keyed(docs)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        dropped = common.durable(exact_dedup.groups(keyed, key=key).where("NOT kept").select("row"))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        left = common.without_rows(keyed, key, dropped)
        assert left.columns == docs.columns
        rows = left.collect()
        assert len(rows) == 1001 and len({r.text for r in rows}) == 1001 and {r.row for r in rows} == {"mine"}
        assert 2999 in {r.doc_id for r in rows}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    language = corpus_pipeline.language_id(spark, docs, None)
    assert language.columns == docs.columns and {(r.row, r.lang_pred, r.score) for r in language.collect()} == {("mine", 1, 2)}


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_folder(type("Session", (), {"sparkContext": Context()}))


def test_durable_rows_have_no_estimate_that_grows(spark):
    df = spark.range(10).selectExpr("id", "id AS a")
    for _ in range(8):
        df = common.durable(df.join(df.toDF("b", "c"), df.id == F.col("b")).select("id", "a"))
    assert df.count() == 10 and df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= 64
