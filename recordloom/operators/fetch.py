"""Records of given ids as lines, and their typed JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.codec import escape, json_string, json_value


def line(uuid: Column, fields: Column) -> Column:
    """`uuid<tab>key=value...`, escaped, keys in byte order."""
    cells = F.transform(entries(fields), lambda e: F.concat(escape(e["key"]), F.lit("="), escape(e["value"])))
    return F.array_join(F.concat(F.array(uuid), cells), "\t")


def entries(fields: Column) -> Column:
    """A record's (key, value), keys in byte order; a value is looked up once, however often an expression has it."""
    return F.array_sort(F.map_entries(fields))


def json_line(uuid: Column, fields: Column) -> Column:
    """`{"_uuid":...}` with numbers and booleans bare, keys in byte order."""
    members = F.transform(entries(fields), lambda e: F.concat(json_string(e["key"]), F.lit(":"), json_value(e["value"])))
    return F.concat(F.lit("{"), F.array_join(F.concat(F.array(F.concat(F.lit('"_uuid":'), json_string(uuid))), members), ","), F.lit("}"))


def missing_line(uuid: Column) -> Column:
    return F.concat(F.lit('{"_uuid":'), json_string(uuid), F.lit(',"_missing":true}'))


def serialized(records: DataFrame) -> DataFrame:
    return records.select("uuid", line(F.col("uuid"), F.col("fields")).alias("line"))


def shown(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Record lines of the ids, by id, each once."""
    return serialized(records.join(ids.select("uuid"), "uuid", "left_semi")).orderBy("uuid")


def json_rows(records: DataFrame, ids: DataFrame) -> DataFrame:
    """pos and JSON of each listed id, in list order; repeats repeat, unknown ids say so."""
    found = ids.join(records, "uuid", "left")
    return found.select("pos", F.when(F.col("fields").isNotNull(), json_line(F.col("uuid"), F.col("fields"))).otherwise(missing_line(F.col("uuid"))).alias("json")).orderBy("pos")
