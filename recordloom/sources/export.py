"""Writers of the text formats. Each file is one sorted sequence of lines, so it is one partition; data at scale stays in Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.codec import escape, footer
from recordloom.operators.fetch import line


def _written(lines: DataFrame, path: str) -> None:
    """lines: section, at and value; sorted by both into one text file in the folder path."""
    lines.repartition(1).sortWithinPartitions("section", "at").select("value").write.mode("overwrite").text(path)


def _footer(df: DataFrame) -> DataFrame:
    now = footer(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp()))
    return df.sparkSession.range(1).select(F.lit(9).alias("section"), F.lit("").alias("at"), F.concat(F.lit("# "), now).alias("value"))


def _section(df: DataFrame, section: int, at: Column, value: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), at.alias("at"), value.alias("value"))


def write_database(records: DataFrame, pending: DataFrame, path: str) -> None:
    """Records by id, a blank line always, pending actions by seq, a timestamp."""
    text = line(F.col("uuid"), F.col("fields"))
    action = F.concat(F.when(F.col("op") == "!", "+").otherwise(F.col("op")), F.when(F.col("op") == "-", F.col("uuid")).otherwise(text))
    blank = _section(records.sparkSession.range(1), 1, F.lit(""), F.lit(""))
    parts = _section(records, 0, F.col("uuid"), text).union(blank).union(_section(pending, 2, F.lpad(F.col("seq").cast("string"), 19, "0"), action))
    _written(parts.union(_footer(records)), path)


def write_rows(rows: DataFrame, path: str) -> None:
    """An index: its columns escaped, tab-separated, in the byte order of the plain columns, and a timestamp."""
    text = {c: F.col(c).cast("string") for c in rows.columns}
    # The ids of a packed row are the last sort column, and lines are made after the sort, which so holds them once.
    at = F.concat_ws("\x00", *[t for c, t in text.items() if c != "uuids"])
    plain = rows.select(F.lit(0).alias("section"), at.alias("at"), *[t.alias(c) for c, t in text.items()])
    stamp = _footer(rows).select("section", "value", *[F.lit("") for _ in rows.columns])
    ordered = plain.union(stamp).repartition(1).sortWithinPartitions("section", "at", *[c for c in rows.columns if c == "uuids"])
    cells = [c if c in ("uuids", "uuid", "count", "norm", "type") else escape(F.col(c)) for c in rows.columns]
    value = F.when(F.col("section") == 0, F.concat_ws("\t", *cells)).otherwise(F.col("at"))
    ordered.select(value.alias("value")).write.mode("overwrite").text(path)


def write_lines(rows: DataFrame, column: str, by: str, path: str, stamp: bool) -> None:
    """Record lines (stamped) or JSON lines (not)."""
    at = F.lpad(F.col(by).cast("string"), 19, "0") if dict(rows.dtypes)[by] in ("int", "bigint") else F.col(by)
    parts = _section(rows, 0, at, F.col(column))
    _written(parts.union(_footer(rows)) if stamp else parts, path)
