import pytest
from pyspark.sql import functions as F

from recordloom.errors import ParseError
from recordloom.operators import index, predicates
from recordloom.operators.predicates import MapFields, WideFields
from recordloom.plans.criteria import Group, Leaf, parse_filter, parse_lookup

A, B, C, D = "AGk26cH00001", "AGk26cH00002", "AGk26cH00003", "AGk26cH00004"
PEOPLE = {A: {"name": "Alice", "city": "Tokyo", "age": "30"}, B: {"name": "Bob", "city": "Tokyo", "age": "25"}, C: {"name": "Carol", "city": "London", "age": "40"}, D: {"name": "Dave"}}
FLAGS = {A: {"name": "Alice", "done": "true"}, B: {"name": "Bob", "done": "false"}, C: {"name": "Carol"}}
ROLES = {A: {"name": "Alice", "role": '["admin","editor","viewer"]'}, B: {"name": "Bob", "role": "viewer"}, C: {"role": "[]"}}
SCORES = {A: {"score": '["10","60","70"]'}, B: {"score": "5"}}
MIXED = {A: {"age": "30"}, B: {"age": "oldish"}, C: {"age": "NaN"}}
CITIES = {A: {"city": "東京"}, B: {"city": "Tokyo"}}
SIGNS = {A: {"temp": "-30"}, B: {"temp": "-5"}, C: {"temp": "10"}}
TIES = {A: {"age": "30", "pi": "3.14"}, B: {"age": "30.0", "pi": "3.14000"}, C: {"age": "31", "pi": "3.15"}}
ODD = {A: {"note": "hello\tworld", "#k": "#v", "k=q": "x"}}

FILTERS = [
    (PEOPLE, "has\tage", [A, B, C]), (PEOPLE, "nohas\tage", [D]), (PEOPLE, "eq\tcity\tTokyo", [A, B]), (PEOPLE, "ne\tcity\tTokyo", [C]),
    (PEOPLE, "lt\tname\tBob", [A]), (PEOPLE, "le\tname\tBob", [A, B]), (PEOPLE, "gt\tname\tBob", [C, D]), (PEOPLE, "ge\tname\tBob", [B, C, D]),
    (PEOPLE, "pre\tcity\tTo", [A, B]), (PEOPLE, "suf\tcity\ton", [C]), (PEOPLE, "sub\tcity\tk", [A, B]), (PEOPLE, "sub\tcity\t%", []),
    (PEOPLE, "ngt\tage\t25", [A, C]), (PEOPLE, "nge\tage\t25.0", [A, B, C]), (PEOPLE, "nlt\tage\t30", [B]), (PEOPLE, "nle\tage\t30", [A, B]), (PEOPLE, "nne\tage\t30", [B, C]),
    (PEOPLE, "", [A, B, C, D]), (PEOPLE, "# mode\tunion\n", [A, B, C, D]), (PEOPLE, "and\nend", [A, B, C, D]), (PEOPLE, "or\nend", []),
    (PEOPLE, "# mode\tunion\neq\tname\tDave\neq\tcity\tLondon", [C, D]), (PEOPLE, "# mode\tunions\neq\tcity\tTokyo\neq\tname\tBob", [B]),
    (PEOPLE, "or\nand\neq\tcity\tTokyo\nngt\tage\t28\nend\nnohas\tcity\nend", [A, D]), (PEOPLE, "has\tnone", []), (PEOPLE, "nohas\tnone", [A, B, C, D]),
    (FLAGS, "ne\tdone\ttrue", [B]), (ROLES, "eq\trole\tviewer", [A, B]), (ROLES, "ne\trole\tadmin", [B, C]), (ROLES, "has\trole", [A, B, C]), (ROLES, "pre\trole\ted", [A]),
    (SCORES, "ngt\tscore\t50", [A]), (SCORES, "nne\tscore\t5", [A]), (MIXED, "ngt\tage\t1", [A]), (MIXED, "nne\tage\t1", [A]), (MIXED, "ngt\tage\tmany", []),
    (CITIES, "gt\tcity\tT", [A, B]), (SIGNS, "nlt\ttemp\t0", [A, B]), (TIES, "neq\tage\t30", [A, B]), (TIES, "neq\tpi\t3.140", [A, B]),
    (ODD, "eq\tnote\thello\\x09world", [A]), (ODD, "eq\t#k\t#v", [A]), (ODD, "eq\tk\\x3Dq\tx", [A]),
]
LOOKUPS = [
    (PEOPLE, "city\tTokyo", [A, B]), (PEOPLE, "Tokyo", [A, B]), (PEOPLE, "city", [A, B, C]), (PEOPLE, "", []), (PEOPLE, "# mode\tunion\nname\tDave\nLondon", [C, D]), (PEOPLE, "city\tTokyo\nname\tBob", [B]),
    (FLAGS, "@absent\tdone", [C]), (FLAGS, "@absent\tdone\ttrue", [B, C]), (FLAGS, "@present\tdone", [A, B]), (ROLES, "role\tviewer", [B]), (ROLES, 'role\t["admin","editor","viewer"]', [A]), (ODD, "note\thello\\x09world", []),
]


def records(spark, data):
    return spark.createDataFrame(list(data.items()), "uuid string, fields map<string,string>")


def found(df):
    return [r.uuid for r in df.collect()]


@pytest.mark.parametrize("case", range(len(FILTERS)))
def test_filters(spark, case):
    data, text, want = FILTERS[case]
    rows, tree = records(spark, data), parse_filter(text)
    assert found(predicates.matching(rows, tree)) == want
    keys = sorted({k for f in data.values() for k in f})
    wide = rows.select("uuid", *[F.try_element_at("fields", F.lit(k)).alias(k) for k in keys])
    if not any("[" in v for f in data.values() for v in f.values()):
        assert found(predicates.matching(wide, tree, WideFields.of(wide))) == want
    if "[]" not in str(data):
        pairs = index.pairs_of(rows)
        assert found(predicates.matching_triples(index.exploded_by_key(pairs), index.universe(pairs), tree)) == want


@pytest.mark.parametrize("case", range(len(LOOKUPS)))
def test_lookups(spark, case):
    data, text, want = LOOKUPS[case]
    assert found(predicates.matching(records(spark, data), parse_lookup(text))) == want


def test_wide_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("cast(id AS string) AS uuid", "cast(id % 3 AS string) AS a", "'x' AS b").write.parquet(str(tmp_path / "t"))
    wide = spark.read.parquet(str(tmp_path / "t"))
    plan = predicates.matching(wide, parse_filter("eq\ta\t1"), WideFields.of(wide))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(a,1)" in plan and "ReadSchema: struct<uuid:string,a:string>" in plan


def test_warnings_come_with_the_scan(spark):
    got, warnings = predicates.matching_with_warnings(records(spark, MIXED), parse_filter("ngt\tage\t1\nneq\tage\tmany"))
    assert found(got) == [] and warnings() == {"ngt age 1": 2, "neq age many": 1}
    got, warnings = predicates.matching_with_warnings(records(spark, MIXED), parse_filter("ngt\tage\t1"))
    assert found(got) == [A] and warnings() == {"ngt age 1": 2}
    assert predicates.matching_with_warnings(records(spark, MIXED), parse_filter("has\tage"))[1]() == {}


def test_set_algebra(spark):
    has, tokyo = Leaf("has", "age"), Leaf("eq", "city", "London")
    assert found(predicates.matching(records(spark, PEOPLE), predicates.intersection(has, tokyo))) == [C]
    assert found(predicates.matching(records(spark, PEOPLE), predicates.union(Leaf("nohas", "age"), tokyo))) == [C, D]


@pytest.mark.parametrize(("text", "line"), [("is\ta\tb", 1), ("has", 1), ("eq\ta", 1), ("has\ta\tb", 1), ("\neq\ta\t[x]", 2), ("eq\ta\t{x}", 1), ("end", 1), ("and\nhas\ta", 1), ("eq\t\\q\tb", 1), ("eq\ta\t\\x0", 1), ("and\nor\nand\nor\nand\nend\nend\nend\nend\nend", 5)])
def test_filter_errors(text, line):
    with pytest.raises(ParseError) as e:
        parse_filter(text)
    assert e.value.line == line


def test_depth_four_is_fine():
    assert parse_filter("and\nor\nand\nor\nend\nend\nend\nend").parts[0].parts[0].parts[0].parts[0] == Group("or")
    assert parse_filter("eq\ta\tb\tc").parts == (Leaf("eq", "a", "b\tc"),)


@pytest.mark.parametrize("text", ["@other\tx", "@present", "@present\ta\tb", "@absent", "@absent\ta\tb\tc", "@absent\t\\q"])
def test_lookup_errors(text):
    with pytest.raises(ParseError):
        parse_lookup(text)


def test_map_fields_are_two_valued(spark):
    view = MapFields(F.col("fields"))
    values = records(spark, FLAGS).select(predicates.compiled(parse_filter("or\neq\tdone\ttrue\nne\tdone\tx\nend"), view)).collect()
    assert all(r[0] is not None for r in values)
