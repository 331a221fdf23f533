import glob
import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from recordloom.errors import DuplicateId, EmptyRecord, MissingId
from recordloom.functions import ids
from recordloom.operators import fetch, index, log
from recordloom.sources import export, text
from recordloom.sources.text import ACTIONS, RECORDS

IDS = [f"AGk26cH000{i:02d}" for i in range(60)]
GONE = "\x00"


def random_case(seed, n=600):
    r = random.Random(seed)
    base = {u: {k: str(r.randrange(9)) for k in r.sample("abcd", r.randrange(1, 4))} for u in IDS[:30]}
    wal = []
    for seq in range(n):
        op = r.choice("+-~~~!")
        fields = {} if op == "-" else {k: GONE if op == "~" and r.random() < 0.3 else str(r.randrange(99)) for k in r.sample("abcd", r.randrange(1, 3))}
        wal.append((seq, op, r.choice(IDS), fields))
    r.shuffle(wal)
    return base, wal


def model(base, wal, strict=False):
    state = {u: dict(f) for u, f in base.items()}
    for seq, op, u, f in sorted(wal):
        there = u in state
        code = "duplicate" if op == "+" and there else "missing" if op in "-~" and not there else None
        if op == "~" and there:
            after = {k: v for k, v in (state[u] | f).items() if v != GONE}
            code = code or (None if after else "empty")
        if strict and code:
            return seq, code
        if op == "-":
            state.pop(u, None)
        elif op in "+!":
            state[u] = dict(f)
        elif there:
            state[u] = after
    return None if strict else {u: f for u, f in state.items() if f}


def frames(spark, base, wal):
    return spark.createDataFrame(list(base.items()), RECORDS).repartition(3), spark.createDataFrame(wal, ACTIONS).repartition(5)


def as_dict(df):
    rows = df.collect()
    assert len({r.uuid for r in rows}) == len(rows)
    return {r.uuid: r.fields for r in rows}


@pytest.mark.parametrize("seed", range(3))
def test_replay_against_a_model(spark, seed):
    case = random_case(seed)
    base, wal = frames(spark, *case)
    assert as_dict(log.replayed(base, wal)) == model(*case)
    assert as_dict(log.replayed_cells(base, wal)) == model(*case)


@pytest.mark.parametrize("seed", range(8))
def test_first_error_against_a_model(spark, seed):
    base, wal = random_case(seed, 12)
    want = model(base, wal, strict=True)
    got = log.first_error(*frames(spark, base, wal)).collect()
    assert [(r.seq, r.code) for r in got] == ([want] if want else [])


A, B = IDS[:2]
ERRORS = [
    ([(0, "+", A, {"x": "1"})], DuplicateId), ([(0, "-", B, {})], MissingId), ([(0, "~", B, {"x": "1"})], MissingId), ([(0, "~", A, {"a": GONE})], EmptyRecord), ([(0, "!", B, {})], EmptyRecord),
    ([(0, "-", A, {}), (1, "+", A, {"x": "1"}), (2, "~", A, {"x": "2"}), (3, "-", A, {}), (4, "+", A, {"x": "1"}), (5, "+", A, {"x": "1"})], DuplicateId),
    ([(0, "+", B, {"x": "1"}), (1, "~", B, {"x": GONE})], EmptyRecord), ([(0, "-", A, {}), (1, "~", A, {"x": "1"})], MissingId),
]


@pytest.mark.parametrize("case", range(len(ERRORS)))
def test_strict_errors(spark, case):
    wal, kind = ERRORS[case]
    with pytest.raises(kind):
        log.validate(*frames(spark, {A: {"a": "1"}}, wal))


def test_a_whole_batch_is_fine(spark):
    wal = [(0, "-", A, {}), (1, "+", A, {"x": "1"}), (2, "~", A, {"x": GONE, "y": "2"}), (3, "!", B, {"z": "3"}), (4, "~", A, {})]
    base, log_ = frames(spark, {A: {"a": "1"}}, wal)
    log.validate(base, log_)
    assert as_dict(log.replayed_cells(base, log_)) == {A: {"y": "2"}, B: {"z": "3"}}


def test_single_operators(spark):
    base, _ = frames(spark, {A: {"a": "1"}, B: {"b": "2"}}, [(0, "-", A, {})])
    new = spark.createDataFrame([(A, {"x": "9"}), (IDS[5], {"n": "5"})], RECORDS)
    assert as_dict(log.append(base, new)) == {A: {"a": "1"}, B: {"b": "2"}, IDS[5]: {"n": "5"}}
    assert as_dict(log.upsert(base, new)) == {A: {"x": "9"}, B: {"b": "2"}, IDS[5]: {"n": "5"}}
    assert as_dict(log.patch(base, new)) == {A: {"a": "1", "x": "9"}, B: {"b": "2"}}
    assert as_dict(log.delete(base, new)) == {B: {"b": "2"}}
    assert [r.uuid for r in log.existing(base, new.select("uuid")).collect()] == [A]
    assert as_dict(log.lookup(base, B)) == {B: {"b": "2"}}


def test_indexes(spark):
    data = {A: {"name": "Alice", "role": '["admin","editor","admin"]', "n": "1.0"}, B: {"name": "Alice", "role": "editor", "n": "-2", "e": "[]"}}
    pairs = index.pairs_of(spark.createDataFrame(list(data.items()), RECORDS))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert ("name", "Alice", f"{A},{B}") in rows(index.packed_by_key(pairs)) and ("Alice", "name", f"{A},{B}") in rows(index.packed_by_value(pairs))
    assert rows(index.exploded_by_key(pairs.where("key IN ('role', 'e')"))) == [("role", "admin", A), ("role", "editor", A), ("role", "editor", B)]
    assert rows(index.numeric(index.exploded_by_key(pairs))) == [("N9998_7~", "n", "-2", B), ("P0001_1", "n", "1.0", A)]
    assert rows(index.profile(pairs.where("key = 'role'"))) == [("role", "array", 1, A), ("role", "string", 1, B)]
    assert len(rows(index.universe(pairs))) == 2
    many = spark.range(500).select(ids.numbered("Q", F.col("id")).alias("uuid"), F.lit("k").alias("key"), F.lit("v").alias("value"))
    dealt = index.packed_by_key(many, chunks=4).collect()
    assert len(dealt) == 4 and sum(len(r.uuids.split(",")) for r in dealt) == 500
    with pytest.raises(Exception, match="malformed array"):
        index.exploded_by_key(pairs.withColumn("value", F.lit("[a]"))).collect()


def test_output(spark):
    records = spark.createDataFrame([(A, {"z": "1", "a=b": "x\ty", "ok": "true", "t": "20262903143022", "r": '["1","q\\"q"]'})], RECORDS)
    assert fetch.serialized(records).first().line == f'{A}\ta\\x3Db=x\\x09y\tok=true\tr=["1","q\\\\"q"]\tt=20262903143022\tz=1'
    wanted = spark.createDataFrame([(1, B), (2, A), (3, A)], "pos long, uuid string")
    lines = [r.json for r in fetch.json_rows(records, wanted).collect()]
    assert lines[0] == f'{{"_uuid":"{B}","_missing":true}}' and lines[1] == lines[2]
    assert lines[1] == f'{{"_uuid":"{A}","a=b":"x\\ty","ok":true,"r":["1","q\\"q"],"t":"20262903143022","z":1}}'
    assert [r.uuid for r in fetch.shown(records, wanted).collect()] == [A]


def test_a_patch_that_empties_a_record_raises(spark):
    base = spark.createDataFrame([(A, {"a": "1"}), (B, {"b": "1"})], RECORDS)
    rows = spark.createDataFrame([(A, {"a": GONE})], RECORDS)
    with pytest.raises(PySparkException, match="no fields"):
        log.patch(base, rows).collect()
    assert as_dict(log.patch(base, spark.createDataFrame([(A, {"a": GONE, "c": "2"}), (IDS[5], {"x": "1"})], RECORDS))) == {A: {"c": "2"}, B: {"b": "1"}}


def test_chunks_of_a_profile(spark):
    pairs = spark.createDataFrame([(u, "k", str(i)) for i, u in enumerate(IDS)], "uuid string, key string, value string")
    whole, parts = index.profile(pairs).collect(), index.profile(pairs, chunks=4).collect()
    assert len(whole) == 1 and whole[0]["count"] == 60 and whole[0].uuids == ",".join(IDS)
    assert len(parts) > 1 and sorted(u for r in parts for u in r.uuids.split(",")) == IDS and all(r["count"] == len(r.uuids.split(",")) for r in parts)


def test_packed_rows_longer_than_a_run(spark, tmp_path, monkeypatch):
    """Ids of a value that many records have are listed once each and in order, and such rows' files are read by several tasks."""
    monkeypatch.setattr(index, "RUN", 8)
    ids_ = [f"AGk26cH{i:05d}" for i in range(500)]
    r = random.Random(2)
    pairs = [(u, "k", "all") for u in ids_ + r.sample(ids_, 100)] + [(u, "k", f"v{i % 7}") for i, u in enumerate(ids_)] + [(u, "n", u) for u in ids_]
    r.shuffle(pairs)
    want = {}
    for u, k, v in pairs:
        want.setdefault((k, v), set()).add(u)
    want = sorted((*kv, ",".join(sorted(us))) for kv, us in want.items())
    made = index.packed_by_key(spark.createDataFrame(pairs, "uuid string, key string, value string").repartition(5))
    assert made.columns == ["key", "value", "uuids"] and sorted(map(tuple, made.collect())) == want
    export.write_rows(made, str(tmp_path / "p"))
    (path,) = glob.glob(f"{tmp_path}/p/part-*")
    written = open(path, encoding="utf-8").read().split("\n")
    assert written[:-2] == ["\t".join(x) for x in want] and re.fullmatch("# [0-9]{14}", written[-2]) and written[-1] == ""
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        read = text.read_packed_index(spark, path)
        assert sorted((x.key, x.value, ",".join(x.uuids)) for x in read.collect()) == want
        assert read.select(F.spark_partition_id().alias("p")).distinct().count() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
