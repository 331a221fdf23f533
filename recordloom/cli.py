"""Command line over a snapshot store.

recordloom STORE ACTIONS            apply an action log
recordloom --compact STORE          fold pending actions into a new base
recordloom --import STORE FILE      take over a database file
recordloom --export STORE FOLDER    write a database file
recordloom --relate STORE           build the packed indexes
recordloom --plane STORE            build the exploded, numeric and profile indexes
recordloom --query FILE STORE [--show [-|FOLDER]]
recordloom --filter FILE STORE [--show [-|FOLDER]]
recordloom --records [FILE|-] STORE JSON lines of listed ids
recordloom --help | --version

Exit status: 0 fine, 1 an error in the data, 2 wrong usage.
"""

from __future__ import annotations

import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from recordloom.errors import RecordError
from recordloom.operators import fetch, predicates
from recordloom.operators.store import Store
from recordloom.plans.criteria import Tree, parse_filter, parse_lookup
from recordloom.sources import export, text
from recordloom.sources.text import ACTIONS

VERSION = "0.1.0"


def _out(df: DataFrame, column: str) -> None:
    for row in df.toLocalIterator(prefetchPartitions=True):
        print(row[column])


def _matched(store: Store, tree: Tree, criteria: str, show: list[str]) -> None:
    if len(show) == 2 and show[1] != "-" and store.holds(show[1], criteria):
        return  # written for these criteria and this version already
    records = store.records()
    found, warnings = predicates.matching_with_warnings(records, tree)
    if not show:
        _out(found, "uuid")
    else:
        shown = fetch.shown(records, found)
        if show[1:] in ([], ["-"]):
            _out(shown, "line")
        else:
            export.write_lines(shown, "line", "uuid", show[1], stamp=True)
            store.note(show[1], criteria)
    for name, n in warnings().items():
        if n:
            print(f"warning: {name}: {n} records without a number", file=sys.stderr)


def main(args: list[str]) -> int:
    if args[:1] in (["--help"], ["-h"]):
        print(__doc__)
        return 0
    if args[:1] in (["--version"], ["-V"]):
        print(VERSION)
        return 0
    flag, rest = (args[0], args[1:]) if args and args[0].startswith("--") else ("", args)
    if flag == "" and len(rest) == 2 and rest[1] == "--compact":
        flag, rest = "--compact", rest[:1]
    show = rest[rest.index("--show") :] if "--show" in rest else []
    rest = rest[: rest.index("--show")] if show else rest
    counts = {"": 2, "--compact": 1, "--import": 2, "--export": 2, "--relate": 1, "--plane": 1, "--query": 2, "--filter": 2, "--records": 2}
    if counts.get(flag) != len(rest) or len(show) > 2 or show and flag not in ("--query", "--filter"):
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("recordloom").getOrCreate()
    store = Store(spark, rest[1] if flag in ("--query", "--filter", "--records") else rest[0])
    try:
        if flag == "":
            store.apply(text.read_actions(spark, rest[1]))
        elif flag == "--compact":
            store.compact()
        elif flag == "--import":
            store.load(*text.read_database(spark, rest[1]))
        elif flag == "--export":
            v = store.version()
            export.write_database(store.base(v), store.pending(v) if v.wal else spark.createDataFrame([], ACTIONS), rest[1])
        elif flag in ("--relate", "--plane"):
            for name in ("packed", "universe") if flag == "--relate" else ("exploded", "numeric", "profile", "universe"):
                store.index(name)
        elif flag in ("--query", "--filter"):
            row = spark.read.text(rest[0], wholetext=True).first()
            criteria = row["value"] if row else ""
            _matched(store, (parse_lookup if flag == "--query" else parse_filter)(criteria), f"{flag}\n{criteria}", show)
        else:
            ids = text.ids_in(spark, sys.stdin.buffer.read()) if rest[0] == "-" else text.read_ids(spark, rest[0])
            _out(fetch.json_rows(store.records(), ids), "json")
    except (RecordError, PySparkException, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


