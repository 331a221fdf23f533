"""Readers of the tab-separated text formats: databases, action logs, id lists and index files.

Line numbers matter to databases, action logs and id lists, so such a file is read whole and split on the executors;
they are exchange formats, bounded each, and a directory of them is read in parallel. Index files need no numbers, so
several tasks read one, line by line. Data at scale lives in snapshots (operators.store).
"""

from __future__ import annotations

import codecs
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.errors import InvalidId, ParseError
from recordloom.functions import codec, ids

RECORDS = "uuid string, fields map<string,string>"
ACTIONS = "seq long, op string, uuid string, fields map<string,string>"
OPCODES = ("+", "-", "~", "!")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1) and text of a file; carriage returns at line ends are kept. Text that isn't UTF-8 raises."""
    return _numbered(_whole(spark, path))


def _utf8(c: str) -> Column:
    return F.when(F.is_valid_utf8(c), F.col(c)).otherwise(F.raise_error(F.lit("not UTF-8")).cast("string"))


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(_utf8("value").alias("value"))


def _numbered(whole: DataFrame) -> DataFrame:
    split = whole.select(F.posexplode(F.split("value", "\n", -1)).alias("line", "text"))
    return split.withColumn("line", F.col("line").cast("long") + 1)


def _first_error(checked: DataFrame) -> None:
    row = checked.where("error IS NOT NULL").agg(F.min(F.struct("line", "error")).alias("e")).first()["e"]
    if row:
        raise ParseError(row["line"], row["error"])


def _fields(parts: Column) -> tuple[Column, Column]:
    """Fields of `key=value` parts, and what is wrong with them or null. Repeated keys become arrays, in order."""
    parts = F.filter(parts, lambda p: p != "")
    raw = F.transform(parts, lambda p: F.split(p, "=", 2))
    pair = F.transform(raw, lambda p: F.struct(codec.unescape(p[0]).alias("k"), codec.unescape(F.try_element_at(p, F.lit(2))).alias("v")))
    wrong = (
        F.when(F.exists(raw, lambda p: F.size(p) < 2), "field without =")
        .when(F.exists(pair, lambda p: p["k"].isNull() | p["v"].isNull()), "bad escape")
        .when(F.exists(pair, lambda p: p["k"] == ""), "empty key")
    )
    keys = F.array_distinct(F.transform(pair, lambda p: p["k"]))

    def value(key: Column) -> Column:
        own = F.transform(F.filter(pair, lambda p: p["k"] == key), lambda p: p["v"])
        return F.when(F.size(own) == 1, own[0]).otherwise(codec.encode_array(own))

    return F.when(wrong.isNull(), F.map_from_arrays(keys, F.transform(keys, value))), wrong


def actions_of(rows: DataFrame) -> DataFrame:
    """seq, op, uuid, fields and error of rows line, text of an action log; blank and comment lines go."""
    text = F.regexp_replace("text", "\\r+$", "")
    rows = rows.select("line", text.alias("text")).where((F.col("text") != "") & ~F.col("text").startswith("#"))
    op, uuid, rest = F.substring("text", 1, 1), F.substring("text", 2, 12), F.expr("substring(text, 14)")
    parts = F.split(F.expr("substring(text, 15)"), "\t", -1)
    fields, wrong = _fields(parts)
    raw_values = F.transform(F.filter(parts, lambda p: p != ""), lambda p: codec.unescape(F.try_element_at(F.split(p, "=", 2), F.lit(2))))
    literal = F.exists(raw_values, lambda v: (F.length(v) >= 2) & ((v.startswith("[") & v.endswith("]")) | (v.startswith("{") & v.endswith("}"))))
    error = (
        F.when(~op.isin(*OPCODES), "unknown opcode")
        .when(F.length("text") < 13, "line too short for an id")
        .when(~ids.is_valid(uuid), "invalid id")
        .when((op == "-") & (F.trim(F.translate(rest, "\t", " ")) != ""), "content after a delete")
        .when(op == "-", F.lit(None).cast("string"))
        .when(~rest.startswith("\t"), "expected a tab after the id")
        .when(wrong.isNotNull(), wrong)
        .when(literal, "array and object values aren't allowed; repeat the key")
        .when(op.isin("+", "!") & (F.size(fields) == 0), "no fields")
    )
    none = F.create_map().cast("map<string,string>")
    return rows.select("line", F.col("line").alias("seq"), op.alias("op"), uuid.alias("uuid"), F.when(op == "-", none).otherwise(fields).alias("fields"), error.alias("error"))


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """seq, op, uuid and fields of an action log. The first bad line raises ParseError before anything is used."""
    found = actions_of(lines(spark, path))
    _first_error(found)
    return found.select("seq", "op", "uuid", "fields")


def read_database(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The records (uuid, fields) and the pending actions (seq, op, uuid, fields) of a database file.

    Records come up to the first blank line, pending actions after it. Trailing spaces of a record's last field are
    padding. A missing file is an empty database.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], RECORDS), spark.createDataFrame([], ACTIONS)
    split = lines(spark, path).withColumn("text", F.regexp_replace("text", "\\r+$", ""))
    blank = split.where("text = ''").agg(F.coalesce(F.min("line"), F.lit((1 << 63) - 1))).first()[0]
    sorted_ = split.where(F.col("line") < blank)
    uuid = F.substring("text", 1, 12)
    fields, wrong = _fields(F.split(F.rtrim(F.expr("substring(text, 14)")), "\t", -1))
    error = F.when(F.length("text") < 13, "line too short").when(~ids.is_valid(uuid) | (F.substring("text", 13, 1) != "\t"), "invalid id").otherwise(wrong)
    base = sorted_.select("line", uuid.alias("uuid"), fields.alias("fields"), error.alias("error"))
    pending = actions_of(split.where(F.col("line") > blank))
    pending = pending.withColumn("error", F.when(F.col("error") == "array and object values aren't allowed; repeat the key", F.lit(None).cast("string")).otherwise(F.col("error")))
    _first_error(base.select("line", "error").union(pending.select("line", "error")))
    return base.select("uuid", "fields"), pending.select("seq", "op", "uuid", "fields")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """pos and uuid of an id list; order and repeats are kept. Every line is checked before anything is returned."""
    return _ids(lines(spark, path))


def ids_in(spark: SparkSession, data: bytes) -> DataFrame:
    """read_ids() of a list that is at hand."""
    try:
        return _ids(_numbered(spark.createDataFrame([(data.decode(),)], "value string")))
    except UnicodeDecodeError as e:
        raise ParseError(data.count(b"\n", 0, e.start) + 1, "not UTF-8") from e


def _ids(rows: DataFrame) -> DataFrame:
    error = F.when(F.col("text").endswith("\r"), "CRLF line ends").when((F.col("text") == "") | F.col("text").startswith("#"), F.lit(None).cast("string")).when(F.col("text").startswith("﻿"), "byte-order mark").when(F.octet_length("text") != 12, "expected 12 characters").when(~ids.is_valid(F.col("text")), "invalid id")
    _first_error(rows.select("line", error.alias("error")))
    return rows.where((F.col("text") != "") & ~F.col("text").startswith("#")).select(F.col("line").alias("pos"), F.col("text").alias("uuid"))


def ids_of(spark: SparkSession, uuids: list[str]) -> DataFrame:
    """pos and uuid of ids given as a list."""
    for u in uuids:
        if not ids.valid(u):
            raise InvalidId(u)
    return spark.createDataFrame(list(enumerate(uuids, 1)), "pos long, uuid string")


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file or folder that aren't blank, read by several tasks: text, its file, its part of the file and at, which
    grows within a part. A line's own place differs from run to run, so it must be used in the job that reads it."""
    read = spark.read.text(path, lineSep="\n")
    file = F.regexp_replace("_metadata.file_path", "^([^:/]+):///", "$1:/").alias("file")
    part, at = F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at")
    rows = read.select(file, part, at, _utf8("value").alias("text"))
    # Spark's line reader drops a byte-order mark, which is text here; files that begin with one are read whole.
    marked = [re.sub("^([^:/]+):///", r"\1:/", f) for f in read.inputFiles() if _starts(spark, f) == codecs.BOM_UTF8]
    if marked:
        whole = spark.read.text(path, wholetext=True).select(file, part, _utf8("value").alias("value")).where(F.col("file").isin(marked))
        split = whole.select("file", "part", F.posexplode(F.split("value", "\n", -1)).alias("at", "text"))
        rows = rows.where(~F.col("file").isin(marked)).union(split)
    return rows.where("text <> ''")


def _starts(spark: SparkSession, path: str) -> bytes:
    """The first three bytes of a file."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(path))
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        found = [stream.read() for _ in range(3)]
    finally:
        stream.close()
    return bytes(b for b in found if b >= 0)


def _columns(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Unescaped columns of an index file; its footer is told by its position, so values may start with #.

    Only lines that look like a footer are counted: each file that ends with one has one such line less."""
    rows, text = _placed(spark, path), F.col("text")
    stamped = text.startswith("# ") & text.rlike("^# [0-9]{14}$")
    # The digits, and what may stand after them in the line's last place: fixed width, so that whole texts needn't be sorted.
    stamp = F.when(stamped, F.substring(text, 3, 14).cast("long") * 10_000 + F.ascii(F.right(text, F.lit(1))))
    parts = rows.select("file", "part", "at", stamp.alias("stamp")).groupBy("file", "part").agg(F.max_by("stamp", "at").alias("stamp"))
    last = parts.groupBy("file").agg(F.max_by("stamp", "part").alias("last"))
    alike = rows.where(stamped).groupBy("file", "text", stamp.alias("stamp")).agg(F.count(F.lit(1)).alias("n")).join(last, "file")
    kept = alike.select("text", F.explode(F.array_repeat(F.lit(0), (F.col("n") - F.when(F.col("stamp") == F.col("last"), 1).otherwise(0)).cast("int"))))
    cells = F.split("text", "\t", -1)
    found = rows.where(~stamped).select("text").union(kept.select("text"))
    return found.select(*[F.coalesce(codec.unescape(cells[i]), cells[i]).alias(n) for i, n in enumerate(names)])


def read_packed_index(spark: SparkSession, path: str, by_value: bool = False) -> DataFrame:
    """key, value and uuids (array) of a packed index file."""
    found = _columns(spark, path, ["value", "key", "uuids"] if by_value else ["key", "value", "uuids"])
    return found.select("key", "value", F.split("uuids", ",").alias("uuids"))


def read_exploded_index(spark: SparkSession, path: str, by_value: bool = False) -> DataFrame:
    """key, value and uuid of an exploded index file."""
    return _columns(spark, path, ["value", "key", "uuid"] if by_value else ["key", "value", "uuid"]).select("key", "value", "uuid")


def read_numeric_index(spark: SparkSession, path: str) -> DataFrame:
    return _columns(spark, path, ["norm", "key", "value", "uuid"])


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    return _columns(spark, path, ["key", "type", "count", "uuids"]).select("key", "type", F.col("count").cast("long").alias("count"), F.split("uuids", ",").alias("uuids"))


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    return _columns(spark, path, ["uuid"])


def read_footer(spark: SparkSession, path: str) -> str | None:
    """The timestamp on the last line that isn't blank, or null."""
    row = _placed(spark, path).agg(F.max_by("text", F.struct("file", "part", "at")).alias("t")).first()["t"]
    return row[2:] if row and row.startswith("# ") else None
