import hashlib
import zlib
from collections import Counter, defaultdict
from math import isqrt

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.llm import common, exact_dedup, queries, sharding, topk
from tests.llm import cases


def spark_hash(*values, seed=42):
    """Spark's xxhash64 of integers and longs, each hashed with the last result as its seed."""
    for v, size in values:
        seed = xxhash.xxh64_intdigest(int(v).to_bytes(size, "little", signed=True), seed % 2**64)
    return seed - 2**64 if seed >= 2**63 else seed


def place(row, n, key):
    a = isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        left, right = divmod(row, b)
        for r in range(sharding.ROUNDS):
            if r % 2 == 0:
                left = (left + spark_hash((right, 8), (r, 4), (key, 8)) % a) % a
            else:
                right = (right + spark_hash((left, 8), (r, 4), (key, 8)) % b) % b
        row = left * b + right
        if row < n:
            return row


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1000])
def test_permutation_is_computable_and_a_bijection(spark, n):
    got = [r[0] for r in spark.range(n).orderBy("id").select(sharding.permuted(F.col("id"), n, 7)).collect()]
    assert sorted(got) == list(range(n))
    assert got == [place(i, n, 7) for i in range(n)]


def test_shards_of_hard_rows(spark):
    rows = sharding.shard(cases.documents(spark), shards=4).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in cases.documents(spark).collect())
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    by_id = {i: (t or "").encode() for i, t in enumerate(cases.TEXTS)}
    assert all(r.size == len(by_id[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(by_id[r.doc_id]) for r in rows if r.doc_id is not None)
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    assert sharding.shard(cases.empty(spark)).collect() == []


def test_shards_are_reproducible(spark):
    first, again = (sharding.shard(cases.hot(spark).repartition(k)).collect() for k in (3, 7))
    assert {(r.doc_id, r.shard, r.slot) for r in first} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_sharding_runs_no_python(spark):
    plan = sharding.shard(cases.hot(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_groups(rows):
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[r.text or ""].append((r.doc_id is not None, r.doc_id, i))
    return {t: (max((x[:2] for x in g))[1], len(g)) for t, g in groups.items()}


@pytest.mark.parametrize("broadcast", [True, False])
def test_groups_of_hard_rows(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    rows = cases.documents(spark).collect()
    got = exact_dedup.groups(cases.documents(spark)).collect()
    want = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in brute_groups(rows).items()}
    assert len(got) == len(rows)
    assert all((r.keep_id, r.group_size) == want[r.text_sha256] for r in got)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(list(want))
    assert exact_dedup.groups(cases.empty(spark)).collect() == []


def test_a_hot_group(spark):
    got = exact_dedup.groups(cases.hot(spark))
    assert got.where("kept").count() == 1001
    assert {tuple(r) for r in got.where("group_size > 1").select("keep_id", "group_size").distinct().collect()} == {(2999, 2000)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=200))
def test_rice_codes_round_trip(values):
    hashes = np.unique(np.array(values, np.uint64))
    gaps = np.diff(hashes, prepend=np.uint64(0))
    assert np.array_equal(exact_dedup.hash_list(exact_dedup.rice_encode(gaps), len(hashes)), hashes)


VECTORS = [(0, [1.0, 0.0, -0.5]), (1, [1.0, 0.0, -0.5]), (2, [0.25, 3.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf")]), (7, []), (8, [0.001, -0.001, 2.0]), (50, [1.0, 1.0, 1.0]), (50, [1.0, 1.0, 1.0]), (50, [0.5, 0.0, 0.0]), (None, [9.0, 9.0, 9.0]), (None, [0.5, 0.0, 0.0])]
HUGE = [(100, [1e30, 1.0, 0.0]), (150, [-3e38, 2.0]), (9, [1e10, 1e10, 1.0]), (200, [1e-40, -1e30])]


def brute_top(vectors, k=5):
    fine = [(i, [int(np.floor(np.float32(x).astype(object) * 256)) for x in v]) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, (i, v) in enumerate(fine):
        if i is not None and i % 50 == 0:
            scores = [(min(2**63 - 1, max(1 - 2**63, sum(a * b for a, b in zip(v, w, strict=False)))), j) for n, (j, w) in enumerate(fine) if n != q]
            for r, (s, j) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k], 1):
                yield i, r, j, s


@pytest.mark.parametrize("most", [topk.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("vectors", [VECTORS, VECTORS + HUGE])
def test_top_k_of_hard_rows(spark, vectors, most):
    df = spark.createDataFrame([(i, v, i) for i, v in vectors], "vec_id long, embedding array<float>, score long").repartition(3)
    got = topk.top_k(df, F.pmod("vec_id", F.lit(50)) == 0, broadcast_bytes=most).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute_top(vectors))
    assert topk.top_k(df.limit(0), F.lit(True)).collect() == []


def test_blocks_of_few_rows(monkeypatch):
    """Many blocks a task, ties, and more than k rows of the highest score."""
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.integers(-2, 3, 4).astype(float).tolist()) for i in rng.permutation(300)]
    pack = lambda size, part: list(topk.packer(size, False)([pa.RecordBatch.from_pydict({"vec_id": [i for i, _ in part], "file": [0] * len(part), "at": [i for i, _ in part], "x": pa.array([v for _, v in part], pa.list_(pa.float64()))})]))
    asks = [r for r in rows if r[0] % 50 == 0]
    pairs = [pa.RecordBatch.from_arrays([*b.columns, *q.columns], names=[f"c{i}" for i in range(12)]) for b in pack(7, rows) for q in pack(4, asks)]
    got = {}
    for b in topk.searched(5, False)(pairs):
        for r in b.to_pylist():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = {}
    for i, _, j, s in brute_top(rows):
        want.setdefault(i, []).append((j, s))
    assert got == want


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, tiny, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, tiny).select(*columns).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())
