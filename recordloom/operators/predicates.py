"""Criteria trees as boolean Columns over a record.

A tree is compiled against a view of records: MapFields for the general `fields MAP<STRING,STRING>`, or WideFields
where each key has a column of its own, null where the key is missing. With wide columns, comparisons reach the
Parquet scan as pushed filters and only the columns that a tree mentions are read.

Logic is two-valued: a missing key never matches but for absence tests, and no null leaves a leaf.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from operator import and_, or_
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.codec import elements, encode_array, norm, norm_of
from recordloom.plans.criteria import NUMERIC, Group, Leaf, Tree, leaves


class Fields(Protocol):
    def has(self, key: str) -> Column: ...

    def packed(self, key: str) -> Column:
        """The whole value, arrays in canonical form; null if missing."""
        ...

    def any(self, key: str, test: Callable[[Column], Column]) -> Column:
        """Whether the test holds for an element; null or false if missing."""
        ...

    def token(self, token: str) -> Column:
        """Whether a key or a whole value equals the token."""
        ...


class MapFields:
    def __init__(self, fields: Column) -> None:
        self.fields = fields

    def has(self, key: str) -> Column:
        return F.map_contains_key(self.fields, key)

    def packed(self, key: str) -> Column:
        return F.try_element_at(self.fields, F.lit(key))

    def any(self, key: str, test: Callable[[Column], Column]) -> Column:
        # The value is bound to a lambda's variable, so that it is looked up once, however often elements() has it.
        return F.exists(F.array(self.packed(key)), lambda value: F.exists(elements(value), test))

    def token(self, token: str) -> Column:
        return self.has(token) | F.array_contains(F.map_values(self.fields), token)


class WideFields:
    """columns: key -> (column, whether it is an array of elements). Scalar columns hold no array-shaped values."""

    def __init__(self, columns: Mapping[str, tuple[Column, bool]]) -> None:
        self.columns = columns

    @classmethod
    def of(cls, df: DataFrame, id_col: str = "uuid") -> WideFields:
        return cls({name: (F.col(f"`{name}`"), kind.startswith("array")) for name, kind in df.dtypes if name != id_col})

    def has(self, key: str) -> Column:
        return self.columns[key][0].isNotNull() if key in self.columns else F.lit(False)

    def packed(self, key: str) -> Column:
        if key not in self.columns:
            return F.lit(None).cast("string")
        column, is_list = self.columns[key]
        return encode_array(column) if is_list else column

    def any(self, key: str, test: Callable[[Column], Column]) -> Column:
        if key not in self.columns:
            return F.lit(False)
        column, is_list = self.columns[key]
        return F.exists(column, test) if is_list else test(column)

    def token(self, token: str) -> Column:
        return reduce(or_, [self.has(token), *(F.coalesce(self.packed(k) == token, F.lit(False)) for k in self.columns)])


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _text(op: str, value: str) -> Callable[[Column], Column]:
    return {
        "lt": lambda x: x < value, "le": lambda x: x <= value, "gt": lambda x: x > value, "ge": lambda x: x >= value,
        "eq": lambda x: x == value, "pre": lambda x: x.startswith(value), "suf": lambda x: x.endswith(value), "sub": lambda x: x.contains(value),
    }[op]


def _numeric(op: str, value: str) -> Callable[[Column], Column]:
    return {"nlt": lambda x: norm(x) < value, "nle": lambda x: norm(x) <= value, "ngt": lambda x: norm(x) > value, "nge": lambda x: norm(x) >= value, "neq": lambda x: norm(x) == value}[op]


def compiled_leaf(leaf: Leaf, fields: Fields) -> Column:
    op, key, value = leaf.op, leaf.key, leaf.value
    if op == "has":
        return fields.has(key)
    if op == "nohas":
        return ~fields.has(key)
    if op == "token":
        return fields.token(key)
    if op == "pair":
        return sure(fields.packed(key) == value)
    if op == "absent_pair":
        return ~sure(fields.packed(key) == value)
    if op == "ne":
        return fields.has(key) & ~sure(fields.any(key, lambda x: x == value))
    if op in NUMERIC:
        normal = norm_of(value)
        if normal is None:
            return F.lit(False)
        if op == "nne":
            return sure(fields.any(key, lambda x: norm(x).isNotNull())) & ~sure(fields.any(key, _numeric("neq", normal)))
        return sure(fields.any(key, lambda x: sure(_numeric(op, normal)(x))))
    test = fields.any(key, _text(op, value))
    return test if isinstance(fields, WideFields) and key in fields.columns and not fields.columns[key][1] and op != "ne" else sure(test)


def compiled(tree: Tree, fields: Fields) -> Column:
    """One boolean Column for a whole tree. An empty conjunction holds, an empty disjunction doesn't."""
    if isinstance(tree, Leaf):
        return compiled_leaf(tree, fields)
    parts = [compiled(p, fields) for p in tree.parts]
    return reduce(and_, parts, F.lit(True)) if tree.op == "and" else reduce(or_, parts, F.lit(False))


def matching(records: DataFrame, tree: Tree, fields: Fields | None = None, id_col: str = "uuid") -> DataFrame:
    """Sorted ids of the records that a tree matches; one scan, and the sort's shuffle of ids alone."""
    kept = records.where(compiled(tree, fields or MapFields(F.col("fields"))))
    return kept.select(F.col(id_col).alias("uuid")).orderBy("uuid")


def skip_counts(tree: Tree, fields: Fields) -> dict[str, Column]:
    """For each numeric predicate, a count of the records that have its key but no numeric element.

    A predicate whose argument isn't a number has no match at all and counts one.
    """
    out: dict[str, Column] = {}
    for x in leaves(tree):
        if x.op in NUMERIC:
            name = f"{x.op} {x.key} {x.value}"
            numeric = sure(fields.any(x.key, lambda c: norm(c).isNotNull()))
            out[name] = F.count_if(fields.has(x.key) & ~numeric) if norm_of(x.value) is not None else F.max(F.lit(1)).cast("long")
    return out


def matching_with_warnings(records: DataFrame, tree: Tree, fields: Fields | None = None) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """matching(), and what gives its skip_counts: an aggregate of its own, over the keys of numeric predicates alone.

    It doesn't ride along with the ids: their sort reads its input twice, and what observes it counts twice.
    """
    view = fields or MapFields(F.col("fields"))
    counts = [c.alias(n) for n, c in skip_counts(tree, view).items()]
    if not counts:
        return matching(records, tree, view), dict
    return matching(records, tree, view), lambda: {n: c or 0 for n, c in records.agg(*counts).first().asDict().items()}


def matching_triples(triples: DataFrame, universe: DataFrame, tree: Tree) -> DataFrame:
    """matching() where only an exploded index (key, value, uuid) is at hand: one shuffle for any number of leaves.

    The scan reads the keys that the tree mentions; each leaf is a flag, pre-aggregated by id, and the tree is
    evaluated on the flags. Ids without those keys come from the universe. Of a packed `[]` the index has no row, and
    it has elements only: trees with lookup leaves (token, pair, absent_pair) need matching().
    """
    wanted = list(dict.fromkeys(leaves(tree)))
    if any(x.op in ("token", "pair", "absent_pair") for x in wanted):
        raise ValueError("lookup leaves need whole values")
    if not wanted:
        return universe.select("uuid").where(compiled(tree, WideFields({}))).distinct().orderBy("uuid")
    tests: dict[str, Column] = {}

    def flag(name: str, key: str, test: Column) -> Column:
        tests.setdefault(name, F.bool_or((F.col("key") == key) & sure(test)))
        return sure(F.col(name))

    def of(x: Leaf) -> Column:
        v, n = F.col("value"), norm_of(x.value) if x.op in NUMERIC else None
        i = wanted.index(x)
        if x.op in ("has", "nohas", "ne"):
            has = flag(f"has{i}", x.key, F.lit(True))
            return has if x.op == "has" else ~has if x.op == "nohas" else has & ~flag(f"hit{i}", x.key, v == x.value)
        if x.op in NUMERIC:
            if n is None:
                return F.lit(False)
            if x.op == "nne":
                return flag(f"num{i}", x.key, norm(v).isNotNull()) & ~flag(f"hit{i}", x.key, norm(v) == n)
            return flag(f"hit{i}", x.key, _numeric(x.op, n)(v))
        return flag(f"hit{i}", x.key, _text(x.op, x.value)(v))

    def tree_of(t: Tree) -> Column:
        if isinstance(t, Leaf):
            return of(t)
        parts = [tree_of(p) for p in t.parts]
        return reduce(and_, parts, F.lit(True)) if t.op == "and" else reduce(or_, parts, F.lit(False))

    condition = tree_of(tree)
    if not tests:
        return universe.select("uuid").where(condition).distinct().orderBy("uuid")
    flags = triples.where(F.col("key").isin([x.key for x in wanted])).groupBy("uuid").agg(*(c.alias(n) for n, c in tests.items()))
    return universe.select("uuid").distinct().join(flags, "uuid", "left").where(condition).select("uuid").orderBy("uuid")


def union(*trees: Tree) -> Tree:
    return Group("or", trees)


def intersection(*trees: Tree) -> Tree:
    return Group("and", trees)
