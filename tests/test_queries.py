import hashlib
import os
import random
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from recordloom import queries


@pytest.fixture(scope="module")
def con(tiny):
    con = duckdb.connect()
    for f in os.listdir(tiny):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{tiny}/{f}'")
    return con


@pytest.mark.parametrize("name", queries.queries())
def test_query_matches_sql(spark, tiny, con, name):
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, tiny)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_array_codec_takes_whole_texts(spark, tmp_path):
    texts = ["w " * 150 + 'a "quoted" back\\\\slash\x07 end', "x " * 20000 + '"', "", " "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def md5(x):
        return hashlib.md5(x.encode()).hexdigest()

    want = set()
    for i, t in enumerate(texts):
        items = t.split(" ")
        packed = "[" + ",".join('"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"' for x in items) + "]"
        want.add((i, md5(packed), len(items), md5("|".join(items))))
    assert {tuple(r) for r in queries.queries()["array_codec"](spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("nulls", [0, 2])
def test_ranks_hold_on_many_partitions(spark, tmp_path, nulls):
    """Partitions are merged less where a plan reads more columns; ties, and nulls, which come last."""
    r = random.Random(5)
    cents = [*(r.randrange(-99_999, 999_999) for _ in range(20_000)), *r.choices(range(-50, 50), k=2_000)]
    rows = [(i, n / 100) for i, n in enumerate(cents)] + [(len(cents) + i, None) for i in range(nulls)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    rank = {}
    for i, n in enumerate(sorted(cents), 1):
        rank.setdefault(n, i)
    want = {(i, rank[n], rank[n]) for i, n in enumerate(cents)} | {(len(cents) + i, len(cents) + 1, len(cents) + 1) for i in range(nulls)}
    conf = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k", "spark.sql.autoBroadcastJoinThreshold": "16k"}
    held = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = [(x.id, x.by_number, x.by_text) for x in queries.queries()["norm_order"](spark, str(tmp_path)).collect()]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(got) == len(rows) and set(got) == want
