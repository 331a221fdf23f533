"""Action logs over records: replay, validation and application.

Actions are (seq, op, uuid, fields): + sets a record, ! sets or replaces one, ~ merges fields (a tombstone value
removes its key) and - deletes. Replay is strictly by seq. Records that no action touches never take part in a fold:
they pass an anti join with the touched ids, which Spark broadcasts while they are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from recordloom.errors import DuplicateId, EmptyRecord, MissingId
from recordloom.functions.codec import TOMBSTONE

#: A record's fields as entries, as actions in order have them; entries are cheaper to merge than maps, and can be sorted.
_CELLS = "array<struct<key:string,value:string>>"
_MERGED = "filter(concat(filter({acc}, e -> NOT array_contains(o.cells.key, e.key)), o.cells), e -> e.value <> char(0))"
_AFTER = "CASE WHEN o.op = '-' THEN NULL WHEN o.op IN ('+', '!') THEN o.cells WHEN {acc} IS NULL THEN NULL ELSE " + _MERGED + " END"
#: State after all actions: null is absent.
REPLAY = f"aggregate(ops, CAST(NULL AS {_CELLS}), (acc, o) -> {_AFTER.format(acc='acc')}, s -> map_from_entries(s))"
#: The first seq at which an action leaves a record without fields.
EMPTIED = f"""aggregate(ops, named_struct('acc', CAST(NULL AS {_CELLS}), 'bad', CAST(NULL AS BIGINT)), (s, o) -> named_struct('acc', {_AFTER.format(acc='s.acc')},
 'bad', coalesce(s.bad, CASE WHEN o.op = '!' AND size(o.cells) = 0 THEN o.seq WHEN o.op = '~' AND s.acc IS NOT NULL AND size({_MERGED.format(acc='s.acc')}) = 0 THEN o.seq END)), s -> s.bad)"""


def as_actions(base: DataFrame) -> DataFrame:
    return base.select(F.lit(-1).cast("long").alias("seq"), F.lit("+").alias("op"), "uuid", "fields")


def _ordered(actions: DataFrame) -> DataFrame:
    """Each record's actions in order, fields as entries, by which rows can be sorted."""
    return actions.groupBy("uuid").agg(F.sort_array(F.collect_list(F.struct("seq", "op", F.map_entries("fields").alias("cells")))).alias("ops"))


def split_touched(base: DataFrame, wal: DataFrame) -> tuple[DataFrame, DataFrame]:
    touched = wal.select("uuid").distinct()
    return base.join(touched, "uuid", "left_anti"), base.join(touched, "uuid", "left_semi")


def replayed(base: DataFrame, wal: DataFrame) -> DataFrame:
    """Records after replay, by a fold over each touched record's ordered actions. Lists are as long as a record's log."""
    rest, touched = split_touched(base, wal)
    folded = _ordered(as_actions(touched).unionByName(wal.select("seq", "op", "uuid", "fields"))).select("uuid", F.expr(REPLAY).alias("fields"))
    return rest.select("uuid", "fields").unionByName(folded.where(F.col("fields").isNotNull() & (F.size("fields") > 0)))


def replayed_cells(base: DataFrame, wal: DataFrame) -> DataFrame:
    """Records after replay, by pre-aggregated maxima: each key's last write, of which those since the record's last reset count.

    Needs no list of a record's actions, so a record with a very long log is no hot group of rows in memory. An action
    that isn't a patch writes the null key, with its opcode, too.
    """
    rest, touched = split_touched(base, wal)
    actions = as_actions(touched).unionByName(wal.select("seq", "op", "uuid", "fields"))
    own = F.when(F.col("op") == "-", F.array().cast("array<struct<key:string,value:string>>")).otherwise(F.map_entries("fields"))
    reset = F.when(F.col("op") == "~", F.array().cast("array<struct<key:string,value:string>>")).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("op").alias("value"))))
    last = actions.select("uuid", "seq", F.inline(F.concat(reset, own))).groupBy("uuid", "key").agg(F.max(F.struct("seq", "value")).alias("last"))
    resets = F.max(F.when(F.col("key").isNull(), F.col("last"))).alias("reset")
    whole = last.groupBy("uuid").agg(resets, F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "last"))).alias("cells")).where("reset.value <> '-'")
    kept = F.filter("cells", lambda c: (c["last"]["seq"] >= F.col("reset.seq")) & (c["last"]["value"] != TOMBSTONE))
    folded = whole.select("uuid", F.map_from_entries(F.transform(kept, lambda c: F.struct(c["key"], c["last"]["value"]))).alias("fields")).where(F.size("fields") > 0)
    return rest.select("uuid", "fields").unionByName(folded)


def errors(base: DataFrame, wal: DataFrame) -> DataFrame:
    """seq, uuid and code (duplicate, missing or empty) of every action that its record's state at the time forbids.

    A record exists if its last action that isn't a patch set it, or, before any, if base has it. Only the least seq
    is sure to be an error once earlier ones are mended.
    """
    before = Window.partitionBy("uuid").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    _, touched = split_touched(base, wal)
    known = wal.join(touched.select("uuid").distinct().withColumn("based", F.lit(True)), "uuid", "left")
    sets = F.when(F.col("op") != "~", F.col("op") != "-")
    exists = F.coalesce(F.last(sets, ignorenulls=True).over(before), F.col("based"), F.lit(False))
    code = F.when((F.col("op") == "+") & exists, "duplicate").when(F.col("op").isin("-", "~") & ~exists, "missing")
    by_existence = known.select("seq", "uuid", code.alias("code")).where("code IS NOT NULL")
    may_empty = wal.where((F.col("op") == "~") & F.exists(F.map_values("fields"), lambda v: v == TOMBSTONE) | (F.col("op") == "!") & (F.size("fields") == 0)).select("uuid").distinct()
    logs = _ordered(as_actions(touched).unionByName(wal.select("seq", "op", "uuid", "fields")).join(may_empty, "uuid", "left_semi"))
    by_fields = logs.select(F.expr(EMPTIED).alias("seq"), "uuid", F.lit("empty").alias("code")).where("seq IS NOT NULL")
    return by_existence.unionByName(by_fields)


def first_error(base: DataFrame, wal: DataFrame) -> DataFrame:
    """The one earliest error, or no row."""
    return errors(base, wal).orderBy("seq").limit(1)


def validate(base: DataFrame, wal: DataFrame) -> None:
    """Raises for the first action that can't be applied; nothing is applied then."""
    row = first_error(base, wal).first()
    if row:
        kind = {"duplicate": DuplicateId, "missing": MissingId, "empty": EmptyRecord}[row["code"]]
        raise kind(f"action {row['seq']}: {row['uuid']}")


def append(base: DataFrame, rows: DataFrame) -> DataFrame:
    """base and the rows whose ids it lacks."""
    return base.select("uuid", "fields").unionByName(rows.select("uuid", "fields").join(base.select("uuid"), "uuid", "left_anti"))


def delete(base: DataFrame, ids: DataFrame) -> DataFrame:
    return base.join(ids.select("uuid").distinct(), "uuid", "left_anti")


def existing(base: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(base.select("uuid"), "uuid", "left_semi")


def lookup(base: DataFrame, uuid: str) -> DataFrame:
    """One record. Over a snapshot sorted by id, the scan skips all row groups but one."""
    return base.where(F.col("uuid") == uuid)


def patch(base: DataFrame, rows: DataFrame) -> DataFrame:
    """base with the fields of rows (one for each id) merged in. A record that this empties raises, as does EmptyRecord in validate()."""
    rest, touched = split_touched(base, rows)
    wal = rows.select(F.lit(0).cast("long").alias("seq"), F.lit("~").alias("op"), "uuid", "fields")
    folded = _ordered(as_actions(touched).unionByName(wal)).select("uuid", F.expr(REPLAY).alias("fields")).where("fields IS NOT NULL")
    emptied = F.raise_error(F.concat(F.lit("a patch leaves no fields: "), F.col("uuid"))).cast("map<string,string>")
    return rest.select("uuid", "fields").unionByName(folded.withColumn("fields", F.when(F.size("fields") > 0, F.col("fields")).otherwise(emptied)))


def upsert(base: DataFrame, rows: DataFrame) -> DataFrame:
    """base with the records of rows (one for each id) set or replaced."""
    return delete(base, rows).select("uuid", "fields").unionByName(rows.select("uuid", "fields"))
