import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from recordloom.functions import codec, ids

CLASSES = {
    "string": ["hello", "", "True", "yes", "+5", "1e3", "0x1A", "007", "00001313143022", "00000000000000", "-", "5.", ".5", " 5", "٣", "[", "1\n"],
    "number": ["0", "30", "-5", "3.14", "-3.14", "1", "20262900143022", "-0.0"],
    "boolean": ["true", "false"],
    "array": ["[]", '["a"]', "[bare]"],
    "timestamp": ["20262903143022", "99992903143022", "00012903143022", "20232902120000"],
}
NORMS = {"0": "P0001_0", "5": "P0001_5", "30": "P0002_30", "100": "P0003_100", "3.14": "P0001_3.14", "0.5": "P0001_0.5", "-5": "N9998_4~", "-30": "N9997_69~", "-3.14": "N9998_6.85~", "-0.0": "P0001_0", "3.14000": "P0001_3.14"}
REJECTED = ["1e3", "0x1A", "007", "", " 5", "+5", "5.", "-", '"', "1" * 10_000, None]


def column(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, c string")


def applied(spark, values, f):
    return [r[0] for r in column(spark, values).select(f(F.col("c")), "i").orderBy("i").collect()]


@pytest.mark.parametrize("kind", CLASSES)
def test_classes(spark, kind):
    assert applied(spark, CLASSES[kind], codec.classify) == [kind] * len(CLASSES[kind])


def test_numeric_form(spark):
    assert applied(spark, list(NORMS), codec.norm) == list(NORMS.values())
    assert applied(spark, REJECTED, codec.norm) == [None] * len(REJECTED)
    assert [codec.norm_of(x) for x in NORMS] == list(NORMS.values())
    assert [codec.norm_of(x) for x in REJECTED if x is not None] == [None] * (len(REJECTED) - 1)


def test_numeric_form_orders_as_numbers(spark):
    r = random.Random(7)
    texts = {f"{r.choice(['', '-'])}{r.randrange(10 ** r.choice([1, 2, 5, 40]))}" + r.choice(["", f".{r.randrange(1000)}", f".{r.randrange(100)}000"]) for _ in range(1500)}
    texts = sorted(texts)
    norms = dict(zip(texts, applied(spark, texts, codec.norm), strict=True))
    by_form = sorted(texts, key=lambda t: norms[t].encode())
    assert [Decimal(t) for t in by_form] == sorted(map(Decimal, texts))
    assert all((norms[a] == norms[b]) == (Decimal(a) == Decimal(b)) for a, b in zip(by_form, by_form[1:], strict=False))
    assert all(codec.norm_of(t) == n for t, n in norms.items())


def test_escapes_round_trip(spark):
    r = random.Random(3)
    plain = ["".join(r.choice("ab=\\\t\n\r\x00\x1féл日😀x0") for _ in range(r.choice([0, 3, 40]))) for _ in range(500)] + ["=\\" * 30_000]
    coded = applied(spark, plain, codec.escape)
    assert not any(set(c) & set("\t\n\r=") for c in coded)
    assert applied(spark, coded, codec.unescape) == plain == [codec.unescaped(c) for c in coded]


def test_escapes_that_are_wrong_or_unusual(spark):
    bad = ["\\q", "\\x0", "\\X09", "\\xZZ", "a\\", "\\\\\\"]
    assert applied(spark, bad, codec.unescape) == [None] * len(bad) == [codec.unescaped(x) for x in bad]
    assert applied(spark, ["\\xe9\\xE9\\x41\\x00", "\\\\x41"], codec.unescape) == ["ééA\x00", "\\x41"]


def test_arrays(spark):
    items = [[], ["a"], ["a, b", 'say "x"', "back\\slash"], ["[", "]", "日本", "\t\n"], ["x" * 50_000, "y"], [f"{i}" for i in range(5000)]]
    df = spark.createDataFrame(list(enumerate(items)), "i int, a array<string>").select("i", codec.encode_array(F.col("a")).alias("c"))
    back = df.select("i", "c", codec.decode_array(F.col("c")).alias("a")).orderBy("i").collect()
    assert [r.a for r in back] == items and back[1].c == '["a"]' and back[0].c == "[]"
    assert applied(spark, ["[a]", '["a",]', '["a\\n"]', '["a"', "a"], codec.decode_array) == [None] * 5
    with pytest.raises(Exception, match="malformed array"):
        applied(spark, ["[a]"], codec.elements)


def test_json(spark):
    hard = ['a"b\\c', "".join(map(chr, range(32))), "日本 😀 /"]
    quoted = applied(spark, hard, codec.json_string)
    assert [json.loads(q) for q in quoted] == hard
    assert quoted[1].startswith('"\\u0000') and "\\u001f" in quoted[1] and "\\b" in quoted[1]
    values = ["30.50", "true", "20262903143022", '["30","x"]', "text", "[]"]
    assert applied(spark, values, codec.json_value) == ["30.50", "true", '"20262903143022"', '["30","x"]', '"text"', "[]"]


GOOD, BAD = ["AGk26cH00001", "EGk26cHCKc01", "AGk26cHl0001"], ["aGk26cH00001", "AXk26cH00001", "AGk26zH00001", "AGk26cH0001", "AGk26cH000010", "AGk26cH0l001", "AGk26cH0O001", "AGk26cH00001\n", ""]


def test_ids(spark):
    assert applied(spark, GOOD + BAD, ids.is_valid) == [True] * len(GOOD) + [False] * len(BAD)
    assert [ids.valid(x) for x in GOOD + BAD] == [True] * len(GOOD) + [False] * len(BAD)
    assert str(applied(spark, ["EGk26cHCKc01"], ids.decode)[0]) == "2026-03-29 15:45:12"


def test_ids_round_trip(spark):
    rows = spark.range(0, 3_000_000, 7919).select("id", ids.numbered("Q", F.col("id")).alias("u"))
    back = rows.select("id", "u", ids.is_valid(F.col("u")).alias("ok"), ids.decode(F.col("u")).alias("at"), ids.ordinal(F.col("u")).alias("n")).collect()
    assert all(r.ok for r in back) and len({r.u for r in back}) == len(back)
    assert all((r.at.timestamp() - back[0].at.timestamp()) == r.id // ids.ORDINALS and r.n == r.id % ids.ORDINALS for r in back)
