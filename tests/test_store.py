import glob
import io
import sys
from collections import Counter

import pytest

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from recordloom import cli
from recordloom.errors import CommitConflict, DuplicateId, InvalidId, MissingId, ParseError
from recordloom.operators.store import Store
from recordloom.sources import export, text
from recordloom.sources.text import ACTIONS
from recordloom.streaming import log_stream

A, B, C = "AGk26cH00001", "BGk26cH00002", "CGk26cH00003"


def actions(spark, rows):
    return spark.createDataFrame(rows, ACTIONS)


def records(df):
    return {r.uuid: r.fields for r in df.collect()}


def lines_in(folder):
    (path,) = glob.glob(f"{folder}/part-*")
    return open(path, encoding="utf-8", newline="").read().split("\n")


def test_commits_and_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), threshold=3)
    assert records(store.records()) == {}
    v1 = store.apply(actions(spark, [(0, "+", A, {"n": "1"}), (1, "+", B, {"n": "2"})]))
    assert (v1.number, v1.pending) == (1, 2)
    with pytest.raises(DuplicateId):
        store.apply(actions(spark, [(0, "!", C, {"n": "3"}), (1, "+", A, {"n": "1"})]))
    assert store.version() == v1
    v2 = store.apply(actions(spark, [(0, "~", A, {"m": "5"}), (1, "-", B, {})]))
    assert v2.pending == 0 and v2.base and records(store.records()) == {A: {"n": "1", "m": "5"}}
    assert records(store.records(store.version(1))) == {A: {"n": "1"}, B: {"n": "2"}}
    assert store.apply(actions(spark, [])) == v2


def test_indexes_are_built_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.apply(actions(spark, [(0, "+", A, {"n": "1"})]))
    assert store.index("numeric").count() == 1
    before = sorted(glob.glob(f"{tmp_path}/s/index/**", recursive=True))
    assert store.index("numeric").count() == 1 and sorted(glob.glob(f"{tmp_path}/s/index/**", recursive=True)) == before
    store.apply(actions(spark, [(0, "+", B, {"n": "2"})]))
    assert store.index("numeric").count() == 2 and {store.index(x).count() for x in ("packed", "exploded", "universe")} == {2} and store.index("profile").first()["count"] == 2


def test_a_commit_is_whole_or_absent(spark, tmp_path, monkeypatch):
    """A writer that dies before its manifest has its name leaves no version, and no reader sees a part of one."""
    store = Store(spark, str(tmp_path / "s"))
    v1 = store.apply(actions(spark, [(0, "+", A, {"n": "1"})]))
    with monkeypatch.context() as m:
        m.setattr(store, "_renamed", lambda aside, path: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            store.apply(actions(spark, [(0, "~", A, {"n": "2"})]))
    assert store.version() == v1 and records(store.records()) == {A: {"n": "1"}}
    (tmp_path / "s" / "manifest" / ".2-cut").write_text("{")
    assert store.apply(actions(spark, [(0, "~", A, {"n": "3"})])).number == 2 and records(store.records()) == {A: {"n": "3"}}
    (tmp_path / "aside").write_text("x")
    assert not store._renamed(str(tmp_path / "aside"), f"{tmp_path}/s/manifest/2.json") and not (tmp_path / "aside").exists()
    assert records(store.records()) == {A: {"n": "3"}}


def test_an_import_is_one_commit(spark, tmp_path):
    store, path = Store(spark, str(tmp_path / "s")), tmp_path / "d.txt"
    path.write_text(f"{A}\tn=1\n\n~{A}\tm=2\n+{B}\tn=3\n-{C}\n")
    with pytest.raises(MissingId):
        store.load(*text.read_database(spark, str(path)))
    assert store.versions() == []
    path.write_text(f"{A}\tn=1\n\n~{A}\tm=2\n+{B}\tn=3\n")
    assert store.load(*text.read_database(spark, str(path))).number == 1
    assert records(store.records()) == {A: {"n": "1", "m": "2"}, B: {"n": "3"}}


def test_concurrent_commits(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    Store(spark, root).apply(actions(spark, [(0, "+", A, {"n": "1"}), (1, "+", B, {"n": "1"})]))
    slow = Store(spark, root)
    publish, raced = slow._publish, []

    def late(version):
        if not raced:
            raced.append(Store(spark, root).apply(actions(spark, [(0, "~", B, {"n": "2"})])))
        return publish(version)

    monkeypatch.setattr(slow, "_publish", late)
    assert slow.apply(actions(spark, [(0, "~", A, {"n": "3"})])).number == 3
    assert records(slow.records()) == {A: {"n": "3"}, B: {"n": "2"}}
    raced.clear()
    with pytest.raises(CommitConflict):
        slow.apply(actions(spark, [(0, "~", B, {"n": "9"})]))


LOG = f"""# a comment
+{A}\tname=Dave\trole=admin\trole=editor\tnote=a\\x3Db\\x09

~{B}\tcity=大阪\told=\\x00\r
-{C}  
!{C}\tname=x\t\ty=1=2
"""


def test_action_files(spark, tmp_path):
    (tmp_path / "a.log").write_text(LOG, newline="")
    got = [tuple(r) for r in text.read_actions(spark, str(tmp_path / "a.log")).orderBy("seq").collect()]
    assert got == [(2, "+", A, {"name": "Dave", "role": '["admin","editor"]', "note": "a=b\t"}), (4, "~", B, {"city": "大阪", "old": "\x00"}), (5, "-", C, {}), (6, "!", C, {"name": "x", "y": "1=2"})]


@pytest.mark.parametrize("line", ["*" + A, "+short", "+aGk26cH00001\tk=v", f"+{A}", f"+{A}\t", f"+{A}k=v", f"-{A}\tk=v", f"+{A}\tk", f"+{A}\tk=\\q", f"+{A}\tk=[x]", f"+{A}\tk={{}}", f"+{A}\t=v", f"!{A}\t"])
def test_bad_action_lines(spark, tmp_path, line):
    (tmp_path / "a.log").write_text(f"-{B}\n{line}\n+{C}\tk\n")
    with pytest.raises(ParseError) as e:
        text.read_actions(spark, str(tmp_path / "a.log"))
    assert e.value.line == 2


def test_database_files(spark, tmp_path):
    path = tmp_path / "d.txt"
    path.write_text(f'{A}\tname=Alice\trole=["a","b"]   \n{B}\tname=B\r\n\n~{A}\tage=3\n# 20262903143022\n', newline="")
    base, pending = text.read_database(spark, str(path))
    assert records(base) == {A: {"name": "Alice", "role": '["a","b"]'}, B: {"name": "B"}}
    assert [tuple(r) for r in pending.collect()] == [(4, "~", A, {"age": "3"})]
    export.write_database(base, pending, str(tmp_path / "out"))
    lines = lines_in(tmp_path / "out")
    assert lines[:4] == [f'{A}\tname=Alice\trole=["a","b"]', f"{B}\tname=B", "", f"~{A}\tage=3"] and lines[4].startswith("# ") and lines[5:] == [""]
    (out,) = glob.glob(f"{tmp_path}/out/part-*")
    again = text.read_database(spark, out)
    assert records(again[0]) == records(base)
    assert [x.count() for x in text.read_database(spark, str(tmp_path / "none"))] == [0, 0]
    path.write_text("short\n")
    with pytest.raises(ParseError):
        text.read_database(spark, str(path))


def test_id_lists(spark, tmp_path):
    path = tmp_path / "u.txt"
    path.write_text(f"# ids\n{B}\n\n{A}\n{B}\n")
    assert [r.uuid for r in text.read_ids(spark, str(path)).orderBy("pos").collect()] == [B, A, B]
    for bad in (f"{A}\r\n", "﻿" + A, f" {A}", f"{A} ", "AGk26zH00001", "x"):
        path.write_text(f"{B}\n{bad}" if bad[0] != "﻿" else bad, newline="")
        with pytest.raises(ParseError):
            text.read_ids(spark, str(path))
    with pytest.raises(InvalidId):
        text.ids_of(spark, ["nope"])
    assert [r.uuid for r in text.ids_in(spark, f"# ids\n{B}\n\n{A}\n{B}".encode()).orderBy("pos").collect()] == [B, A, B]
    for bad in (f"{A}\r\n".encode(), b"\xef\xbb\xbf" + A.encode(), f"{A} {B}".encode(), b"\xff\xfe"):
        with pytest.raises(ParseError):
            text.ids_in(spark, bad)


def test_text_that_is_not_utf8_is_an_error(spark, tmp_path):
    (tmp_path / "d.txt").write_bytes(f"{A}\tn=caf".encode() + b"\xe9\n")
    with pytest.raises(PySparkException, match="not UTF-8"):
        text.read_database(spark, str(tmp_path / "d.txt"))


def test_index_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.apply(actions(spark, [(0, "+", A, {"#k": "#v=1", "n": "-2"}), (1, "+", B, {"n": "10"})]))
    readers = {"packed": text.read_packed_index, "exploded": text.read_exploded_index, "numeric": text.read_numeric_index, "profile": text.read_profile, "universe": text.read_universe}
    for name, read in readers.items():
        export.write_rows(store.index(name), str(tmp_path / name))
        (path,) = glob.glob(f"{tmp_path}/{name}/part-*")
        got, want = read(spark, path), store.index(name)
        listed = lambda df: sorted(tuple(",".join(x) if isinstance(x, list) else x for x in r) for r in df.select(*want.columns).collect())
        assert listed(got) == listed(want)
        assert len(text.read_footer(spark, path)) == 14
    assert lines_in(tmp_path / "exploded")[:1] == [f"#k\t#v\\x3D1\t{A}"]


def test_index_files_are_read_in_splits(spark, tmp_path):
    """No task holds a whole file; what is a row or a footer doesn't depend on where a file is cut."""
    rows = [(f"k{i % 7}\ufeff", "x" * (i % 50) + "\t\r\n=", f"{A[:-4]}{i:04d}") for i in range(3000)]
    export.write_rows(spark.createDataFrame(rows, "key string, value string, uuid string"), str(tmp_path / "made"))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = text.read_exploded_index(spark, str(tmp_path / "made"))
        assert Counter(map(tuple, got.collect())) == Counter(rows)
        assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 10
        assert len(text.read_footer(spark, str(tmp_path / "made"))) == 14
        stamp, other = "# 20240101000000", "# 20250101000000"
        (tmp_path / "f").mkdir()
        cases = {"a": f"{stamp}\n{other}\n{A}\n{stamp}\n{stamp}\n\n", "b c%": f"\ufeff{stamp}\n{A}\n{other}", "d": f"{stamp}\n{A}\r\n", "e": "\n" * 9000 + f"{B}\n{other}" + "\n" * 9000, "g": f"{other}\n{other}\r\n"}
        left = {"a": [stamp, other, A, stamp], "b c%": ["\ufeff" + stamp, A], "d": [stamp, A + "\r"], "e": [B], "g": [other]}
        for name, lines in cases.items():
            (tmp_path / "f" / name).write_text(lines, newline="")
            assert Counter(r.uuid for r in text.read_universe(spark, str(tmp_path / "f" / name)).collect()) == Counter(left[name]), name
        assert Counter(r.uuid for r in text.read_universe(spark, str(tmp_path / "f")).collect()) == Counter(sum(left.values(), []))
        (tmp_path / "f" / "h").write_bytes(b"a\n" * 5000 + b"caf\xe9\n")
        with pytest.raises(PySparkException, match="not UTF-8"):
            text.read_universe(spark, str(tmp_path / "f")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_streamed_actions(spark, tmp_path):
    source, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "s"))
    actions(spark, [(0, "+", A, {"n": "1"})]).write.parquet(source)
    run = lambda: log_stream.applied(log_stream.action_rows(spark, source), store, str(tmp_path / "c")).awaitTermination()
    run()
    run()
    actions(spark, [(0, "~", A, {"m": "2"}), (1, "!", B, {"k": "v"})]).write.mode("append").parquet(source)
    run()
    assert records(store.records()) == {A: {"n": "1", "m": "2"}, B: {"k": "v"}} and store.version().number == 2
    # The stream died after its commit and before it noted that: the last batch comes again, and isn't applied again.
    (tmp_path / "c" / "commits" / "1").unlink()
    (tmp_path / "c" / "commits" / ".1.crc").unlink(missing_ok=True)
    run()
    assert store.version().number == 2 and store.version().batches == {str(tmp_path / "c"): 1}
    counted = log_stream.live_counts(log_stream.action_rows(spark, source)).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    counted.awaitTermination()
    assert {r.op: r.n for r in spark.sql("SELECT op, sum(n) AS n FROM live GROUP BY op").collect()} == {"+": 1, "~": 1, "!": 1}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    root, file = str(tmp_path / "s"), tmp_path / "f"
    run = lambda *a: (cli.main(list(a)), capsys.readouterr())
    file.write_text(f"+{A}\tname=Alice\tage=30\n+{B}\tname=Bob\tage=old\n")
    assert run(root, str(file))[0] == 0
    code, out = run(root, str(file))
    assert code == 1 and "error" in out.err
    file.write_text("ngt\tage\t1\n")
    code, out = run("--filter", str(file), root)
    assert (code, out.out.split()) == (0, [A]) and "1 records without a number" in out.err
    file.write_text("Bob\n")
    assert run("--query", str(file), root)[1].out.split() == [B]
    assert run("--query", str(file), root, "--show")[1].out == f"{B}\tage=old\tname=Bob\n"
    assert run("--query", str(file), root, "--show", str(tmp_path / "out"))[0] == 0 and lines_in(tmp_path / "out")[0] == f"{B}\tage=old\tname=Bob"
    first = glob.glob(f"{tmp_path}/out/part-*")
    assert run("--query", str(file), root, "--show", str(tmp_path / "out"))[0] == 0 and glob.glob(f"{tmp_path}/out/part-*") == first
    file.write_text("Alice\n")
    assert run("--query", str(file), root, "--show", str(tmp_path / "out"))[0] == 0 and lines_in(tmp_path / "out")[0].startswith(A)
    file.write_text(f"{C}\n{A}\n")
    assert run("--records", str(file), root)[1].out.split("\n")[:2] == [f'{{"_uuid":"{C}","_missing":true}}', f'{{"_uuid":"{A}","age":30,"name":"Alice"}}']
    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(f"# a comment\n\n{A}\n".encode())))
    assert run("--records", "-", root)[1].out == f'{{"_uuid":"{A}","age":30,"name":"Alice"}}\n'
    assert run("--compact", root)[0] == 0 and run("--relate", root)[0] == 0 and run("--plane", root)[0] == 0
    assert run("--export", root, str(tmp_path / "e"))[0] == 0
    (dump,) = glob.glob(f"{tmp_path}/e/part-*")
    assert run("--import", str(tmp_path / "t"), dump)[0] == 0 and records(Store(spark, str(tmp_path / "t")).records()) == records(Store(spark, root).records())
    file.write_text("bad\n")
    assert run("--filter", str(file), root)[0] == 1
    assert run()[0] == 2 and run("--query", root)[0] == 2 and run("--help")[0] == 0 and run("--version")[1].out.strip() == cli.VERSION
    assert sys.argv
