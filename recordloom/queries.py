"""The catalogue of queries over the test tables, each with the SQL that an independent engine can check it by."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.errors import ParseError
from recordloom.functions import codec, ids
from recordloom.operators import fetch, index, log, predicates, store
from recordloom.operators.predicates import WideFields
from recordloom.plans.criteria import parse_filter, parse_lookup
from recordloom.sources import export, tables, text
from recordloom.streaming import log_stream

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


# --- the tables as records, in SQL -------------------------------------------------------------------------------

def sql_id(kind: str, n: str) -> str:
    t = f"(TIMESTAMP '{ids.EPOCH}' + to_seconds(({n}) // {ids.ORDINALS}))"

    def at(alphabet: str, i: str) -> str:
        return f"substr('{alphabet}', CAST({i} AS INT), 1)"

    places = [at(ids.BASE60, f"year({t}) // 100 + 1"), f"lpad(CAST(year({t}) % 100 AS VARCHAR), 2, '0')", at(ids.MONTHS, f"month({t})"), at(ids.DAYS, f"day({t})"), at(ids.HOURS, f"hour({t}) + 1"), at(ids.BASE60, f"minute({t}) + 1"), at(ids.BASE60, f"second({t}) + 1"), at(ids.BASE62, f"(({n}) % {ids.ORDINALS}) // 62 + 1"), at(ids.BASE62, f"({n}) % 62 + 1")]
    return " || ".join([f"'{kind}G'", *places])


def sql_money(c: str) -> str:
    return f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)"


CUSTOMERS = f"""c AS (SELECT {sql_id("C", "c_custkey")} AS uuid, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation, {sql_money("c_acctbal")} AS acctbal,
 c_mktsegment AS segment, CASE WHEN CAST(c_acctbal AS DECIMAL(18,2)) < 0 THEN CAST(-CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) END AS debt FROM customer)"""
ORDERS = f"""o AS (SELECT {sql_id("O", "o_orderkey")} AS uuid, CAST(o_custkey AS VARCHAR) AS cust, o_orderstatus AS status, {sql_money("o_totalprice")} AS total,
 strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS priority FROM orders)"""
PARTS = f"""p AS (SELECT {sql_id("O", "l_orderkey")} AS uuid, list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR))) AS part FROM lineitem GROUP BY l_orderkey)"""
EVENTS = f"""e AS (SELECT {sql_id("E", "event_id")} AS uuid, CAST(user_id AS VARCHAR) AS "user", event_type AS type, CASE WHEN event_type = 'purchase' THEN {sql_money("value")} END AS value,
 CASE event_id % 5 WHEN 0 THEN {sql_money("value")} WHEN 1 THEN CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END WHEN 2 THEN strftime(ts, '%Y%d%m%H%M%S')
 WHEN 3 THEN event_type ELSE '["' || {sql_money("value")} || '","' || event_type || '"]' END AS mixed FROM events)"""
DOCUMENTS = f"""d AS (SELECT {sql_id("D", "doc_id")} AS uuid, lang, source, CAST(n_chars AS VARCHAR) AS n_chars, chr(9) || chr(92) || '=' || text AS text FROM documents)"""
#: name -> adapter, common table expression, its name, its keys
RECORDS = {
    "customers": (tables.customers, CUSTOMERS, "c", ("name", "nation", "acctbal", "segment", "debt")),
    "orders": (tables.orders, ORDERS, "o", ("cust", "status", "total", "date", "priority")),
    "parts": (tables.order_parts, PARTS, "p", ("part",)),
    "events": (tables.events, EVENTS, "e", ("user", "type", "value", "mixed")),
    "documents": (tables.documents, DOCUMENTS, "d", ("lang", "source", "n_chars", "text")),
}


def sql_pairs(name: str, keys: tuple[str, ...] | None = None) -> str:
    """Common table expressions, the last one `pairs` (uuid, key, value)."""
    _, cte, alias, own = RECORDS[name]
    rows = " UNION ALL ".join(f"""SELECT uuid, '{k}' AS key, "{k}" AS value FROM {alias} WHERE "{k}" IS NOT NULL""" for k in keys or own)
    return f"WITH {cte}, pairs AS ({rows})"


def sql_number(x: str) -> str:
    return f"CASE WHEN regexp_full_match({x}, '-?(0|[1-9][0-9]*)(\\.[0-9]+)?') THEN CAST({x} AS DECIMAL(38,6)) END"


#: Elements of the events' mixed values.
SQL_ELEMENTS = "CASE WHEN mixed LIKE '[%' THEN string_split(mixed[3:-3], '\",\"') ELSE [mixed] END"


# --- criteria ------------------------------------------------------------------------------------------------------

def criteria(name: str, records: str, text: str, where: str, lookup: bool = False, general: bool = False) -> None:
    """Registers a criteria query: over wide columns, or (general) over the records' map."""
    adapter, cte, alias, _ = RECORDS[records]
    tree = (parse_lookup if lookup else parse_filter)(text)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        wide = adapter(spark, sf_dir)
        return predicates.matching(tables.records(wide), tree) if general else predicates.matching(wide, tree, WideFields.of(wide))

    _QUERIES[name] = run
    _SQL[name] = f"WITH {cte} SELECT uuid FROM {alias} WHERE {where} ORDER BY uuid"


criteria("filter_has", "customers", "has\tdebt", "debt IS NOT NULL")
criteria("filter_nohas", "customers", "nohas\tdebt", "debt IS NULL")
criteria("filter_eq", "customers", "eq\tsegment\tBUILDING", "segment = 'BUILDING'")
criteria("filter_ne", "orders", "ne\tpriority\t1-URGENT", "priority <> '1-URGENT'")
criteria("filter_lt", "orders", "lt\tdate\t1996-06-01", "date < '1996-06-01'")
criteria("filter_le", "orders", "le\ttotal\t2", "total <= '2'")
criteria("filter_gt", "customers", "gt\tacctbal\t5", "acctbal > '5'")
criteria("filter_ge", "orders", "ge\tpriority\t3-MEDIUM", "priority >= '3-MEDIUM'")
criteria("filter_pre", "documents", "pre\ttext\t\\x09\\\\=The", "starts_with(text, chr(9) || chr(92) || '=The')")
criteria("filter_suf", "documents", "suf\ttext\t.", "ends_with(text, '.')")
criteria("filter_sub", "documents", "sub\ttext\ta.\\x0A", "contains(text, 'a.' || chr(10))")
criteria("filter_sub_word", "documents", "sub\ttext\ttoken", "contains(text, 'token')")
criteria("filter_neq", "customers", "neq\tnation\t7.0", "CAST(nation AS DECIMAL(38,6)) = 7")
criteria("filter_nne", "customers", "nne\tdebt\t100", "CAST(debt AS DECIMAL(38,6)) <> 100")
criteria("filter_nlt", "customers", "nlt\tacctbal\t-500.5", "CAST(acctbal AS DECIMAL(38,6)) < -500.5")
criteria("filter_nle", "orders", "nle\ttotal\t20000", "CAST(total AS DECIMAL(38,6)) <= 20000")
criteria("filter_ngt", "customers", "ngt\tacctbal\t1000", "CAST(acctbal AS DECIMAL(38,6)) > 1000")
criteria("filter_nge", "orders", "nge\ttotal\t400000.00", "CAST(total AS DECIMAL(38,6)) >= 400000")
criteria("filter_numeric_mixed", "events", "ngt\tmixed\t100", f"len(list_filter({SQL_ELEMENTS}, lambda x: {sql_number('x')} > 100)) > 0", general=True)
criteria("filter_not_a_number", "customers", "ngt\tacctbal\t1e3", "false")
criteria("filter_array_eq", "parts", "eq\tpart\t77", "list_contains(part, '77')")
criteria("filter_array_ne", "parts", "ne\tpart\t77", "NOT list_contains(part, '77')")
criteria("filter_array_lt", "parts", "lt\tpart\t11", "len(list_filter(part, lambda x: x < '11')) > 0")
criteria("filter_array_pre", "parts", "pre\tpart\t199", "len(list_filter(part, lambda x: starts_with(x, '199'))) > 0", general=True)
criteria("filter_array_ngt", "parts", "ngt\tpart\t195", "len(list_filter(part, lambda x: CAST(x AS DECIMAL(38,6)) > 195)) > 0")
criteria("filter_array_nne", "parts", "nne\tpart\t77.0", "len(list_filter(part, lambda x: CAST(x AS DECIMAL(38,6)) = 77)) = 0")
criteria("filter_and", "orders", "eq\tstatus\tF\nngt\ttotal\t200000\nnohas\tpriority", "status = 'F' AND CAST(total AS DECIMAL(38,6)) > 200000 AND priority IS NULL")
criteria("filter_or", "orders", "or\neq\tstatus\tP\nnlt\ttotal\t5000\nend", "status = 'P' OR CAST(total AS DECIMAL(38,6)) < 5000")
criteria(
    "filter_nested4", "orders", "or\nand\neq\tstatus\tO\nor\npre\tdate\t1995\nand\nhas\tpriority\nngt\ttotal\t300000\nend\nend\nend\neq\tcust\t42\nend",
    "(status = 'O' AND (starts_with(date, '1995') OR (priority IS NOT NULL AND CAST(total AS DECIMAL(38,6)) > 300000))) OR cust = '42'",
)
criteria("filter_union_mode", "orders", "# mode\tunion\neq\tstatus\tP\n# a comment\npre\tpriority\t1", "status = 'P' OR starts_with(priority, '1')")
criteria("filter_match_all", "customers", "# mode\tunion\n", "true")
criteria("filter_empty_or", "customers", "or\nend", "false")
criteria("filter_empty_and", "customers", "and\nend", "true")
criteria("filter_map_records", "customers", "has\tsegment\nngt\tacctbal\t1000\nor\neq\tsegment\tBUILDING\neq\tsegment\tMACHINERY\nend\nnohas\tdebt", "CAST(acctbal AS DECIMAL(38,6)) > 1000 AND segment IN ('BUILDING', 'MACHINERY') AND debt IS NULL", general=True)
criteria("query_token", "events", "purchase", "type = 'purchase' OR mixed = 'purchase' OR \"user\" = 'purchase' OR value = 'purchase'", lookup=True)
criteria("query_token_key", "events", "value", "value IS NOT NULL", lookup=True, general=True)
criteria("query_kv", "orders", "status\tP", "status = 'P'", lookup=True)
criteria("query_kv_packed", "parts", 'part\t["940"]', "len(part) = 1 AND part[1] = '940'", lookup=True, general=True)
criteria("query_present", "events", "@present\tvalue", "value IS NOT NULL", lookup=True)
criteria("query_absent", "orders", "@absent\tpriority", "priority IS NULL", lookup=True)
criteria("query_absent_kv", "orders", "@absent\tpriority\t1-URGENT", "priority IS DISTINCT FROM '1-URGENT'", lookup=True)
criteria("query_union", "orders", "# mode\tunion\nstatus\tP\n@absent\tpriority", "status = 'P' OR priority IS NULL", lookup=True)
criteria("query_intersect", "orders", "# mode\tintersect\nstatus\tF\n@present\tpriority\ncust\t42", "status = 'F' AND priority IS NOT NULL AND cust = '42'", lookup=True)
criteria("query_empty", "orders", "# mode\tunion\n", "false", lookup=True)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


FLAGSHIP = "has\tsegment\nngt\tacctbal\t1000\nor\neq\tsegment\tBUILDING\neq\tsegment\tMACHINERY\nend\nnohas\tdebt"


@query(f"WITH {CUSTOMERS} SELECT uuid, segment, acctbal FROM c WHERE CAST(acctbal AS DECIMAL(38,6)) > 1000 AND segment IN ('BUILDING', 'MACHINERY') AND debt IS NULL")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = tables.customers(spark, sf_dir)
    return wide.where(predicates.compiled(parse_filter(FLAGSHIP), WideFields.of(wide))).select("uuid", "segment", "acctbal").orderBy("uuid")


@query(f"WITH {EVENTS} SELECT uuid FROM e WHERE len(list_filter({SQL_ELEMENTS}, lambda x: {sql_number('x')} > 100)) > 0 AND value IS NULL")
def filter_by_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = tables.pairs(tables.events(spark, sf_dir))
    return predicates.matching_triples(index.exploded_by_key(pairs), index.universe(pairs), parse_filter("ngt\tmixed\t100\nnohas\tvalue"))


@query(f"WITH {EVENTS} SELECT 'ngt mixed 100' AS predicate, count(*) AS skipped FROM e WHERE len(list_filter({SQL_ELEMENTS}, lambda x: {sql_number('x')} IS NOT NULL)) = 0")
def filter_skip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = predicates.skip_counts(parse_filter("ngt\tmixed\t100"), predicates.MapFields(F.col("fields")))
    found = tables.records(tables.events(spark, sf_dir)).agg(*(c.alias(n) for n, c in counts.items()))
    return found.unpivot([], list(counts), "predicate", "skipped")


@query(f"""WITH {EVENTS}, hit AS (SELECT count(*) AS n FROM e WHERE len(list_filter({SQL_ELEMENTS}, lambda x: {sql_number('x')} > 100)) > 0 AND CAST("user" AS DECIMAL(38,6)) < 500)
 SELECT 'ngt mixed 100' AS predicate, count(*) AS skipped, (SELECT n FROM hit) AS matched FROM e WHERE len(list_filter({SQL_ELEMENTS}, lambda x: {sql_number('x')} IS NOT NULL)) = 0 UNION ALL SELECT 'nlt user 500', 0, (SELECT n FROM hit)""")
def filter_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command line prints: matches of a filter and, for each numeric predicate, the records without a number."""
    found, warnings = predicates.matching_with_warnings(tables.records(tables.events(spark, sf_dir)), parse_filter("ngt\tmixed\t100\nnlt\tuser\t500"))
    n = found.count()
    return spark.createDataFrame([(name, skipped, n) for name, skipped in warnings().items()], "predicate string, skipped long, matched long")


@query(f"""WITH {ORDERS} SELECT uuid FROM (SELECT uuid FROM o WHERE status = 'F' UNION SELECT uuid FROM o WHERE priority IS NULL)
 EXCEPT SELECT uuid FROM o WHERE starts_with(date, '1995')""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = tables.orders(spark, sf_dir)
    hit = [predicates.compiled(parse_filter(t), WideFields.of(wide)) for t in ("eq\tstatus\tF", "nohas\tpriority", "pre\tdate\t1995")]
    return wide.where((hit[0] | hit[1]) & ~predicates.sure(hit[2])).select("uuid")


# --- indexes -------------------------------------------------------------------------------------------------------

def pairs_of(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: tables.pairs(RECORDS[name][0](spark, sf_dir))


PACKED = "string_agg(DISTINCT uuid, ',' ORDER BY uuid) AS uuids"
EXPLODED = f"WITH {EVENTS}, x AS (SELECT DISTINCT key, value, uuid FROM (SELECT 'mixed' AS key, unnest({SQL_ELEMENTS}) AS value, uuid FROM e UNION ALL SELECT 'user', \"user\", uuid FROM e UNION ALL SELECT 'type', type, uuid FROM e UNION ALL SELECT 'value', value, uuid FROM e WHERE value IS NOT NULL))"


@query(f"{sql_pairs('orders')} SELECT key, value, {PACKED} FROM pairs GROUP BY key, value")
def relate_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.packed_by_key(pairs_of("orders")(spark, sf_dir))


@query(f"{sql_pairs('customers')} SELECT value, key, {PACKED} FROM pairs GROUP BY key, value")
def relate_vk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.packed_by_value(pairs_of("customers")(spark, sf_dir))


@query(f"{sql_pairs('orders')} SELECT DISTINCT uuid FROM pairs")
def relate_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.universe(pairs_of("orders")(spark, sf_dir))


@query(f"{EXPLODED} SELECT key, value, uuid FROM x")
def plane_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.exploded_by_key(pairs_of("events")(spark, sf_dir))


@query(f"{EXPLODED} SELECT value, key, uuid FROM x")
def plane_vk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.exploded_by_value(index.pairs_of(tables.records(tables.events(spark, sf_dir))))


@query(f"""{EXPLODED}, n AS (SELECT key, value, uuid, regexp_full_match(value, '-.*') AND CAST(value AS DECIMAL(38,6)) <> 0 AS neg, split_part(ltrim(value, '-'), '.', 1) AS i, rtrim(split_part(value, '.', 2), '0') AS f
 FROM x WHERE regexp_full_match(value, '-?(0|[1-9][0-9]*)(\\.[0-9]+)?')), m AS (SELECT *, lpad(CAST(len(i) AS VARCHAR), 4, '0') || '_' || i || CASE WHEN f <> '' THEN '.' || f ELSE '' END AS mag FROM n)
 SELECT CASE WHEN neg THEN 'N' || translate(mag, '0123456789', '9876543210') || '~' ELSE 'P' || mag END AS norm, key, value, uuid FROM m""")
def plane_ord(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.numeric(index.exploded_by_key(pairs_of("events")(spark, sf_dir)))


SQL_CLASS = "CASE WHEN starts_with(value, '[') AND ends_with(value, ']') AND len(value) >= 2 THEN 'array' WHEN regexp_full_match(value, '[0-9]{4}(0[1-9]|[12][0-9]|3[01])(0[1-9]|1[0-2])([01][0-9]|2[0-3])[0-5][0-9][0-5][0-9]') THEN 'timestamp' WHEN value IN ('true', 'false') THEN 'boolean' WHEN regexp_full_match(value, '-?(0|[1-9][0-9]*)(\\.[0-9]+)?') THEN 'number' ELSE 'string' END"


@query(f"{sql_pairs('events')} SELECT key, {SQL_CLASS} AS type, count(*) AS count, string_agg(uuid, ',' ORDER BY uuid) AS uuids FROM pairs GROUP BY key, type")
def kt_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.profile(pairs_of("events")(spark, sf_dir))


# --- scalar functions ------------------------------------------------------------------------------------------------

@query(f"{sql_pairs('events')} SELECT uuid, key, value, {SQL_CLASS} AS type FROM pairs")
def classify_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of("events")(spark, sf_dir).select("uuid", "key", "value", codec.classify(F.col("value")).alias("type"))


@query("""WITH n AS (SELECT c_custkey AS id, CAST(c_acctbal AS DECIMAL(18,2)) AS x FROM customer), s AS (SELECT id, x, CAST(abs(x) AS VARCHAR) AS a FROM n),
 p AS (SELECT id, x, split_part(a, '.', 1) AS i, rtrim(split_part(a, '.', 2), '0') AS f FROM s),
 m AS (SELECT id, x, lpad(CAST(len(i) AS VARCHAR), 4, '0') || '_' || i || CASE WHEN f <> '' THEN '.' || f ELSE '' END AS mag FROM p),
 k AS (SELECT id, x, CASE WHEN x < 0 THEN 'N' || translate(mag, '0123456789', '9876543210') || '~' ELSE 'P' || mag END AS norm FROM m)
 SELECT id, norm, rank() OVER (ORDER BY x) AS by_number, rank() OVER (ORDER BY norm) AS by_text FROM k""")
def norm_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    balances = tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("decimal(18,2)").alias("x"))
    keyed = ranked = balances.withColumn("norm", codec.norm(F.col("x").cast("string")))
    # Ranks by counts of smaller values, which are pre-aggregated; a window without keys would need one task.
    for by, name in (("x", "by_number"), ("norm", "by_text")):
        ranks = _ranks(keyed, by, name).withColumnRenamed(by, "of")
        ranked = ranked.join(ranks, F.col(by).eqNullSafe(F.col("of"))).drop("of")
    return ranked.select("id", "norm", "by_number", "by_text")


#: Ranges that _ranks() cuts the values into.
RANGES = 1024


def _ranks(df: DataFrame, by: str, name: str) -> DataFrame:
    """Each value of a column and its rank() over the whole table, nulls last.

    Rows are counted by value, and each range of values adds the rows of the ranges before it. The ranges are cut at
    the values of the least hashes, which are the same however often and on whatever partitions the plan is run; numbers
    of partitions, or bounds that Spark samples, differ between two uses of one table.
    """
    from pyspark.sql import Window

    value = F.col(by)
    values = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    bounds = values.select(by).orderBy(F.xxhash64(by), by).limit(RANGES - 1).agg(F.array_sort(F.collect_list(by)).alias("bounds"))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(RANGES.bit_length()))])
    part = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("bounds", at + step - 1) <= value, at + step).otherwise(at))
    ordered = values.crossJoin(F.broadcast(bounds)).select(by, "n", F.when(value.isNull(), RANGES).otherwise(part).alias("part"))

    def sum_before(window: Window) -> Column:
        return F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    before = ordered.groupBy("part").agg(F.sum("n").alias("n")).select("part", sum_before(Window.orderBy("part")).alias("before"))
    inner = ordered.withColumn("inner", sum_before(Window.partitionBy("part").orderBy(F.asc_nulls_last(by))))
    return inner.join(F.broadcast(before), "part").select(by, (F.col("before") + F.col("inner") + 1).alias(name))


SQL_VALID = "regexp_full_match(u, '[A-Z]G[0-9a-km-zA-NP-Z][0-9]{2}[a-fA-F][0-9a-kA-J][0a-lA-K][0-9a-km-zA-NP-Z]{2}[0-9a-zA-Z]{2}')"
SQL_SPOILT = "CASE event_id % 4 WHEN 0 THEN uuid WHEN 1 THEN lower(uuid) WHEN 2 THEN substr(uuid, 1, 5) || 'z' || substr(uuid, 7) ELSE uuid || '0' END"


@query(f"WITH e AS (SELECT event_id, {sql_id('E', 'event_id')} AS uuid FROM events), s AS (SELECT {SQL_SPOILT} AS u FROM e) SELECT u AS uuid, {SQL_VALID} AS valid FROM s")
def uuid_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, u = F.col("event_id"), F.col("u")
    made = tables.read(spark, sf_dir, "events").select("event_id", ids.numbered("E", n).alias("u"))
    spoilt = F.when(n % 4 == 0, u).when(n % 4 == 1, F.lower(u)).when(n % 4 == 2, F.concat(F.substring(u, 1, 5), F.lit("z"), F.expr("substring(u, 7)"))).otherwise(F.concat(u, F.lit("0")))
    return made.select(spoilt.alias("uuid")).select("uuid", ids.is_valid(F.col("uuid")).alias("valid"))


def sql_time_id(kind: str, t: str, n: str) -> str:
    return sql_id(kind, n).replace(f"(TIMESTAMP '{ids.EPOCH}' + to_seconds(({n}) // {ids.ORDINALS}))", t)


@query(f"SELECT event_id, {sql_time_id('E', 'ts', 'event_id % 3844')} AS uuid FROM events")
def uuid_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read(spark, sf_dir, "events")
    return rows.select("event_id", ids.encode("E", F.col("ts").cast("timestamp_ntz"), F.col("event_id") % ids.ORDINALS).alias("uuid"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, CAST(event_id % 3844 AS BIGINT) AS ordinal FROM events")
def uuid_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("uuid")
    return uuid_encode(spark, sf_dir).select("event_id", F.date_format(ids.decode(u), "yyyy-MM-dd HH:mm:ss").alias("at"), ids.ordinal(u).cast("long").alias("ordinal"))


@query(f"""WITH u AS (SELECT event_id, ts, {sql_time_id('E', 'ts', 'event_id % 3844')} AS uuid FROM events), d AS (SELECT date_trunc('day', ts) AS day, min(uuid) AS least, max(uuid) AS most, arg_min(uuid, ts) AS first FROM u GROUP BY 1)
 SELECT strftime(day, '%Y-%m-%d') AS day, least, most, date_trunc('hour', (SELECT min(ts) FROM u WHERE date_trunc('day', u.ts) = d.day)) AS from_hour FROM d""")
def uuid_chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a day by bytes, and the hour that the day's ids begin in by time: the orders differ."""
    made = uuid_encode(spark, sf_dir).withColumn("at", ids.decode(F.col("uuid")))
    days = made.groupBy(F.date_format("at", "yyyy-MM-dd").alias("day")).agg(F.min("uuid").alias("least"), F.max("uuid").alias("most"), F.date_trunc("hour", F.min("at")).alias("from_hour"))
    return days.select("day", "least", "most", F.col("from_hour").cast("timestamp_ntz").alias("from_hour"))


def sql_stamp(name: str) -> str:
    def at(i: str) -> str:
        return f"substr('{ids.STAMPS[name]}', CAST({i} + 1 AS INT), 1)"

    return " || ".join([f"'{name}'", at("year(ts) // 100"), "lpad(CAST(year(ts) % 100 AS VARCHAR), 2, '0')", *(at(f"{part}(ts)") for part in ("month", "day", "hour", "minute", "second"))])


@query(f"SELECT event_id, {', '.join(f'{sql_stamp(n)} AS {n.lower()}' for n in ids.STAMPS)}, strftime(ts, '%Y-%m-%d %H:%M:%S') AS back, 1 AS times FROM events")
def time_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's time in the six plain formats, and the one time that all of them decode to."""
    at = F.col("ts").cast("timestamp_ntz")
    made = tables.read(spark, sf_dir, "events").select("event_id", *[ids.stamp(n, at).alias(n.lower()) for n in ids.STAMPS])
    back = F.array_distinct(F.array(*[ids.stamped(F.col(n.lower())) for n in ids.STAMPS]))
    return made.select("*", F.date_format(back[0], "yyyy-MM-dd HH:mm:ss").alias("back"), F.size(back).alias("times"))


SQL_ESCAPED = "replace(replace(replace(replace(replace({}, chr(92), chr(92) || chr(92)), chr(9), chr(92) || 'x09'), chr(10), chr(92) || 'x0A'), chr(13), chr(92) || 'x0D'), '=', chr(92) || 'x3D')"


@query(f"WITH {DOCUMENTS} SELECT uuid, md5({SQL_ESCAPED.format('text')}) AS escaped, md5(text) AS back FROM d")
def escape_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = tables.documents(spark, sf_dir).select("uuid", codec.escape(F.col("text")).alias("escaped"))
    return coded.select("uuid", F.md5("escaped").alias("escaped"), F.md5(codec.unescape(F.col("escaped"))).alias("back"))


@query("""WITH i AS (SELECT doc_id, string_split(text, ' ') AS items FROM documents)
 SELECT doc_id, md5('[' || array_to_string(list_transform(items, lambda x: '"' || replace(replace(x, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"'), ',') || ']') AS packed, CAST(len(items) AS INTEGER) AS n, md5(array_to_string(items, '|')) AS back FROM i""")
def array_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = tables.read(spark, sf_dir, "documents").select("doc_id", F.split("text", " ", -1).alias("items"))
    coded = items.select("doc_id", codec.encode_array(F.col("items")).alias("packed"))
    back = codec.decode_array(F.col("packed"))
    return coded.select("doc_id", F.md5("packed").alias("packed"), F.size(back).alias("n"), F.md5(F.array_join(back, "|")).alias("back"))


@query("SELECT event_id, '# ' || strftime(ts, '%Y%d%m%H%M%S') AS footer FROM events")
def footer_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("# "), codec.footer(F.col("ts"))).alias("footer"))


# --- mutation --------------------------------------------------------------------------------------------------------

def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An action log from events over orders: signup !, view and click ~ (a click deletes status), error -, purchase +."""
    rows = tables.read(spark, sf_dir, "events")
    kind, n = F.col("event_type"), F.col("event_id").cast("string")
    op = F.when(kind == "signup", "!").when(kind == "error", "-").when(kind == "purchase", "+").otherwise("~")
    last = F.create_map(F.lit("last"), kind, F.lit("n"), n)
    fields = F.when(op == "-", F.create_map().cast("map<string,string>")).when(kind == "click", F.create_map(F.lit("status"), F.lit(codec.TOMBSTONE), F.lit("last"), kind, F.lit("n"), n)).when(kind == "purchase", F.create_map(F.lit("total"), tables.money("value"), F.lit("last"), kind)).otherwise(last)
    return rows.select(F.col("event_id").alias("seq"), op.alias("op"), ids.numbered("O", F.col("user_id")).alias("uuid"), fields.alias("fields"))


LOG = f"""{ORDERS}, w0 AS (SELECT event_id AS seq, {sql_id("O", "user_id")} AS u, CASE event_type WHEN 'signup' THEN '!' WHEN 'error' THEN '-' WHEN 'purchase' THEN '+' ELSE '~' END AS op, event_type, {sql_money("value")} AS v FROM events),
 w AS (SELECT seq, u, op FROM w0 UNION ALL SELECT -1, uuid, '+' FROM o),
 k AS (SELECT seq, u, op, 'last' AS k, event_type AS v FROM w0 WHERE op <> '-' UNION ALL SELECT seq, u, op, 'n', CAST(seq AS VARCHAR) FROM w0 WHERE op IN ('!', '~')
  UNION ALL SELECT seq, u, op, 'total', v FROM w0 WHERE op = '+' UNION ALL SELECT seq, u, op, 'status', NULL FROM w0 WHERE event_type = 'click'
  UNION ALL {" UNION ALL ".join(f"SELECT -1, uuid, '+', '{c}', {c} FROM o WHERE {c} IS NOT NULL" for c in RECORDS["orders"][3])}),
 r AS (SELECT u, max(seq) AS rs, arg_max(op, seq) AS ro FROM w WHERE op <> '~' GROUP BY u),
 l AS (SELECT k.u, k.k, k.v FROM k JOIN r USING (u) WHERE k.seq >= r.rs AND r.ro <> '-' QUALIFY row_number() OVER (PARTITION BY k.u, k.k ORDER BY k.seq DESC) = 1)"""
REPLAYED = f"WITH {LOG} SELECT u AS uuid, string_agg({SQL_ESCAPED.format('k')} || '=' || {SQL_ESCAPED.format('v')}, chr(9) ORDER BY k) AS fields FROM l WHERE v IS NOT NULL GROUP BY u"


def _lines(records: DataFrame) -> DataFrame:
    cells = F.transform(fetch.entries(F.col("fields")), lambda e: F.concat(codec.escape(e["key"]), F.lit("="), codec.escape(e["value"])))
    return records.select("uuid", F.array_join(cells, "\t").alias("fields"))


def base_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.records(tables.orders(spark, sf_dir))


@query(REPLAYED)
def compact_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(log.replayed(base_orders(spark, sf_dir), actions(spark, sf_dir)))


@query(REPLAYED)
def compact_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(log.replayed_cells(base_orders(spark, sf_dir), actions(spark, sf_dir)))


@query(f"""WITH {ORDERS}, n AS (SELECT {sql_id("O", "c_custkey * 30")} AS uuid, c_name AS name FROM customer)
 SELECT uuid, 'cust=' || cust AS mark FROM o UNION ALL SELECT uuid, 'name=' || name FROM n WHERE uuid NOT IN (SELECT uuid FROM o)""")
def apply_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = tables.read(spark, sf_dir, "customer").select(ids.numbered("O", F.col("c_custkey") * 30).alias("uuid"), F.create_map(F.lit("name"), "c_name").alias("fields"))
    return _marked(log.append(base_orders(spark, sf_dir), new))


def _marked(records: DataFrame) -> DataFrame:
    f = F.col("fields")
    return records.select("uuid", F.coalesce(F.concat(F.lit("cust="), F.try_element_at(f, F.lit("cust"))), F.concat(F.lit("name="), F.try_element_at(f, F.lit("name")))).alias("mark"))


@query(f"WITH {ORDERS} SELECT uuid FROM o WHERE uuid NOT IN (SELECT {sql_id('O', 'user_id')} FROM events WHERE event_type = 'error')")
def apply_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = actions(spark, sf_dir).where("op = '-'").select("uuid")
    return log.delete(base_orders(spark, sf_dir), gone).select("uuid")


@query(f"""WITH {ORDERS}, n AS (SELECT DISTINCT {sql_id("O", "user_id")} AS uuid FROM events)
 SELECT o.uuid, CASE WHEN n.uuid IS NULL THEN status END AS status, CASE WHEN n.uuid IS NULL THEN NULL ELSE 'yes' END AS seen, total FROM o LEFT JOIN n USING (uuid)""")
def apply_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = F.create_map(F.lit("status"), F.lit(codec.TOMBSTONE), F.lit("seen"), F.lit("yes"))
    rows = actions(spark, sf_dir).select("uuid").distinct().withColumn("fields", change)
    done = log.patch(base_orders(spark, sf_dir), rows)
    return done.select("uuid", *[F.try_element_at("fields", F.lit(k)).alias(k) for k in ("status", "seen", "total")])


@query(f"""WITH {ORDERS}, n AS (SELECT {sql_id("O", "c_custkey * 30")} AS uuid, c_name AS name FROM customer)
 SELECT uuid, 'name=' || name AS mark FROM n UNION ALL SELECT uuid, 'cust=' || cust FROM o WHERE uuid NOT IN (SELECT uuid FROM n)""")
def apply_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = tables.read(spark, sf_dir, "customer").select(ids.numbered("O", F.col("c_custkey") * 30).alias("uuid"), F.create_map(F.lit("name"), "c_name").alias("fields"))
    return _marked(log.upsert(base_orders(spark, sf_dir), new))


EXISTENCE = f"""WITH {LOG}, x AS (SELECT w.seq, w.u, w.op, coalesce(last_value(CASE WHEN op = '~' THEN NULL ELSE op <> '-' END IGNORE NULLS) OVER (PARTITION BY u ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS there FROM w),
 bad AS (SELECT seq, u AS uuid, CASE WHEN op = '+' AND there THEN 'duplicate' WHEN op IN ('-', '~') AND NOT there THEN 'missing' END AS code FROM x WHERE seq >= 0)"""


@query(f"{EXISTENCE} SELECT seq, uuid, code FROM bad WHERE code IS NOT NULL ORDER BY seq LIMIT 1")
def validate_first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.first_error(base_orders(spark, sf_dir), actions(spark, sf_dir))


#: Orders that only have a status, and a log in which every third patch removes it; every fifth order has a second action.
EMPTYING = f"""WITH {ORDERS}, n AS (SELECT o_orderkey AS k, {sql_id("O", "o_orderkey")} AS uuid FROM orders),
 w AS (SELECT k AS seq, uuid, k % 3 = 0 AS empties, k % 7 = 0 AS upsert FROM n UNION ALL SELECT k + 1000000000, uuid, true, false FROM n WHERE k % 5 = 0)"""


@query(f"{EXISTENCE}, x2 AS (SELECT seq, uuid, code FROM bad WHERE code IS NOT NULL) SELECT seq, uuid, code FROM x2")
def validate_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error of the log; none of its actions empties a record, as views follow clicks and write `last`."""
    return log.errors(base_orders(spark, sf_dir), actions(spark, sf_dir))


@query(f"{EMPTYING}, e AS (SELECT uuid, seq FROM w WHERE upsert OR empties) SELECT min(seq) AS seq, uuid, 'empty' AS code FROM e GROUP BY uuid")
def validate_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions that leave a record without fields: upserts without any, and patches that remove the only one."""
    k = F.col("o_orderkey")
    rows = tables.read(spark, sf_dir, "orders").select(k, ids.numbered("O", k).alias("uuid"))
    base = rows.select("uuid", F.create_map(F.lit("status"), F.lit("x")).alias("fields"))
    gone, kept, none = F.create_map(F.lit("status"), F.lit(codec.TOMBSTONE)), F.create_map(F.lit("status"), F.lit("y")), F.create_map().cast("map<string,string>")
    first = rows.select(k.alias("seq"), F.when(k % 7 == 0, "!").otherwise("~").alias("op"), "uuid", F.when(k % 7 == 0, none).when(k % 3 == 0, gone).otherwise(kept).alias("fields"))
    again = rows.where(k % 5 == 0).select((k + 1000000000).alias("seq"), F.lit("~").alias("op"), "uuid", gone.alias("fields"))
    return log.errors(base, first.unionByName(again))


@query(f"WITH {ORDERS} SELECT DISTINCT {sql_id('O', 'user_id')} AS uuid FROM events WHERE {sql_id('O', 'user_id')} IN (SELECT uuid FROM o)")
def existing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.existing(base_orders(spark, sf_dir), actions(spark, sf_dir).select("uuid").distinct())


@query(f"WITH {ORDERS} SELECT uuid, 'cust=' || cust AS mark FROM o WHERE uuid = (SELECT {sql_id('O', 'CAST(42 AS BIGINT)')})")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.range(42, 43).select(ids.numbered("O", F.col("id"))).first()[0]
    return _marked(log.lookup(base_orders(spark, sf_dir), wanted))


# --- output ----------------------------------------------------------------------------------------------------------

def sql_line(keys: tuple[str, ...]) -> str:
    cells = [f"""CASE WHEN "{k}" IS NULL THEN '' ELSE chr(9) || '{k}=' || {SQL_ESCAPED.format(f'"{k}"')} END""" for k in sorted(keys)]
    return "uuid || " + " || ".join(cells)


@query(f"WITH {CUSTOMERS} SELECT uuid, {sql_line(RECORDS['customers'][3])} AS line FROM c WHERE segment = 'BUILDING'")
def show_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = tables.records(tables.customers(spark, sf_dir))
    return fetch.shown(records, predicates.matching(records, parse_filter("eq\tsegment\tBUILDING")))


@query(f"WITH {DOCUMENTS} SELECT uuid, {sql_line(RECORDS['documents'][3])} AS line FROM d")
def serialize_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetch.serialized(tables.records(tables.documents(spark, sf_dir)))


SQL_JSON = "CASE WHEN value IS NULL THEN '' ELSE ',\"value\":' || value END"
SQL_MIXED = f"CASE ({SQL_CLASS.replace('value', 'mixed')}) WHEN 'number' THEN mixed WHEN 'boolean' THEN mixed WHEN 'array' THEN mixed ELSE '\"' || mixed || '\"' END"
JSON = f"""'{{"_uuid":"' || uuid || '","mixed":' || {SQL_MIXED} || ',"type":"' || type || '","user":' || "user" || {SQL_JSON} || '}}'"""


@query(f"""WITH {EVENTS}, i AS (SELECT event_id * 2 AS pos, {sql_id('E', 'event_id')} AS uuid FROM events UNION ALL SELECT event_id * 2 + 1, {sql_id('E', 'event_id')} FROM events WHERE event_id % 10 = 0)
 SELECT pos, {JSON} AS json FROM i JOIN e USING (uuid)""")
def records_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of every event, and of each tenth twice."""
    rows = tables.read(spark, sf_dir, "events").select("event_id", ids.numbered("E", F.col("event_id")).alias("uuid"))
    again = rows.where("event_id % 10 = 0").select((F.col("event_id") * 2 + 1).alias("pos"), "uuid")
    return fetch.json_rows(tables.records(tables.events(spark, sf_dir)), rows.select((F.col("event_id") * 2).alias("pos"), "uuid").union(again))


@query(f"""WITH {EVENTS}, i AS (SELECT event_id AS pos, {sql_id('E', 'event_id * 2')} AS uuid FROM events)
 SELECT pos, CASE WHEN e.uuid IS NULL THEN '{{"_uuid":"' || i.uuid || '","_missing":true}}' ELSE {JSON.replace('|| uuid ||', '|| i.uuid ||')} END AS json FROM i LEFT JOIN e USING (uuid)""")
def records_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = tables.read(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), ids.numbered("E", F.col("event_id") * 2).alias("uuid"))
    return fetch.json_rows(tables.records(tables.events(spark, sf_dir)), wanted)


@query("""SELECT doc_id, '"' || replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't'), chr(13), chr(92) || 'r') || '"' AS quoted FROM documents""")
def json_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "documents").select("doc_id", codec.json_string(F.col("text")).alias("quoted"))


# --- files: written, read back, and compared with what they were made of -----------------------------------------------

def folder(spark: SparkSession) -> str:
    """A new folder where the cluster shares files; a session in one process may use a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{shared or tempfile.mkdtemp(prefix='recordloom-')}/files-{uuid.uuid4().hex}"


@query(f"WITH {CUSTOMERS} SELECT uuid, {sql_line(RECORDS['customers'][3])} AS line FROM c")
def file_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    export.write_database(tables.records(tables.customers(spark, sf_dir)), spark.createDataFrame([], text.ACTIONS), path)
    return fetch.serialized(text.read_database(spark, path)[0])


SQL_ACTION = f"""{sql_id("O", "event_id")} AS uuid, 'n=' || event_id || chr(9) || 'type=' || {SQL_ESCAPED.format("chr(9) || event_type")} AS fields"""


@query(f"SELECT event_id + 2 AS seq, '~' AS op, {SQL_ACTION} FROM events")
def file_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending actions of a database without records: they follow a blank line, and count lines from there."""
    path, n = folder(spark), F.col("event_id")
    fields = F.create_map(F.lit("n"), n.cast("string"), F.lit("type"), F.concat(F.lit("\t"), "event_type"))
    rows = tables.read(spark, sf_dir, "events").select(n.alias("seq"), F.lit("~").alias("op"), ids.numbered("O", n).alias("uuid"), fields.alias("fields"))
    export.write_database(spark.createDataFrame([], text.RECORDS), rows, path)
    found = text.read_database(spark, path)[1]
    return found.select("seq", "op", "uuid").join(_lines(found), "uuid")


@query(f"SELECT event_id + 1 AS seq, CASE event_id % 3 WHEN 0 THEN '+' WHEN 1 THEN '~' ELSE '!' END AS op, {SQL_ACTION} FROM events")
def file_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An action log, its lines in order of the events."""
    path, n = folder(spark), F.col("event_id")
    op = F.when(n % 3 == 0, "+").when(n % 3 == 1, "~").otherwise("!")
    value = F.concat(op, ids.numbered("O", n), F.lit("\tn="), n.cast("string"), F.lit("\ttype="), codec.escape(F.concat(F.lit("\t"), "event_type")))
    tables.read(spark, sf_dir, "events").select(n, value.alias("value")).repartition(1).sortWithinPartitions("event_id").select("value").write.text(path)
    found = text.read_actions(spark, path)
    return found.select("seq", "op", "uuid").join(_lines(found), "uuid")


#: Criteria that are wrong, and the line that says so; whether they are lookups.
WRONG = [
    ("is\ta\tb", 1, False), ("has", 1, False), ("eq\ta", 1, False), ("has\ta\tb", 1, False), ("\neq\ta\t[x]", 2, False), ("eq\ta\t{x}", 1, False), ("end", 1, False), ("has\ta\nhas\tb\nend", 3, False),
    ("eq\t\\q\tb", 1, False), ("eq\ta\t\\x0", 1, False), ("and\nor\nand\nor\nand\nend\nend\nend\nend\nend", 5, False), ("a\tb\n@other\tx", 2, True), ("@present", 1, True), ("@present\ta\tb", 1, True), ("@absent\ta\tb\tc", 1, True),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {line})" for i, (_, line, _) in enumerate(WRONG)) + ") AS t(criteria, line)")
def criteria_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    def line(criteria: str, lookup: bool) -> int:
        try:
            (parse_lookup if lookup else parse_filter)(criteria)
        except ParseError as e:
            return e.line
        return 0

    return spark.createDataFrame([(i, line(c, lookup)) for i, (c, _, lookup) in enumerate(WRONG)], "criteria int, line int")


#: Lines of an action log after a good id, and whether they are wrong.
LINES = [("+", "\tk=v", False), ("*", "\tk=v", True), ("+", "", True), ("+", "\t", True), ("+", "k=v", True), ("-", "\tk=v", True), ("-", "  ", False), ("+", "\tk", True), ("~", "\tk=\\q", True), ("~", "\tk=[x]", True), ("!", "\tk={}", True), ("+", "\t=v", True), ("~", "\tk=\\x00", False), ("!", "\ta=1\ta=2", False)]


@query(f"SELECT CAST({len(LINES)} * event_id + i + 1 AS BIGINT) AS line, wrong FROM events, (VALUES " + ", ".join(f"({i}, {'true' if wrong else 'false'})" for i, (_, _, wrong) in enumerate(LINES)) + ") AS t(i, wrong)")
def action_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of an action log are wrong; every event's record has a line of each kind."""
    n = F.col("event_id")
    value = F.explode(F.array(*[F.struct((n * len(LINES) + i + 1).alias("line"), F.concat(F.lit(op), ids.numbered("O", n), F.lit(rest)).alias("text")) for i, (op, rest, _) in enumerate(LINES)]))
    rows = tables.read(spark, sf_dir, "events").select(value.alias("r")).select("r.line", "r.text")
    return text.actions_of(rows).select("line", F.col("error").isNotNull().alias("wrong"))


def index_file(name: str, sql: str, made: Callable[[SparkSession, str], DataFrame], read: Callable[[SparkSession, str], DataFrame]) -> None:
    """Registers a query that writes an index to a file, reads it back and gives its rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, rows = folder(spark), made(spark, sf_dir)
        export.write_rows(rows, path)
        found = read(spark, path)
        return found.select(*[F.array_join(c, ",").alias(c) if kind == "array<string>" else c for c, kind in found.dtypes])

    _QUERIES[name], _SQL[name] = run, sql


index_file("file_packed", _SQL["relate_kv"], relate_kv, text.read_packed_index)
index_file("file_exploded", _SQL["plane_kv"], plane_kv, text.read_exploded_index)
index_file("file_numeric", _SQL["plane_ord"], plane_ord, text.read_numeric_index)
index_file("file_profile", _SQL["kt_profile"], kt_profile, text.read_profile)
index_file("file_universe", _SQL["relate_uuid"], relate_uuid, text.read_universe)


@query(f"SELECT event_id + 1 AS pos, {sql_id('E', 'event_id // 2')} AS uuid FROM events")
def file_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id list; every id is listed twice."""
    path, n = folder(spark), F.col("event_id")
    rows = tables.read(spark, sf_dir, "events").select(n.alias("pos"), ids.numbered("E", F.floor(n / 2)).alias("uuid"))
    export.write_lines(rows, "uuid", "pos", path, stamp=False)
    return text.read_ids(spark, path)


@query(f"""WITH l AS (SELECT user_id, max(event_id) AS n FROM events GROUP BY user_id) SELECT {sql_id("O", "user_id")} AS uuid, 'n=' || n AS fields FROM l""")
def store_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of actions committed to a store batch by batch: the last upsert of each record is what it holds."""
    path, n = folder(spark), F.col("event_id")
    rows = tables.read(spark, sf_dir, "events").select(n.alias("seq"), F.lit("!").alias("op"), ids.numbered("O", F.col("user_id")).alias("uuid"), F.create_map(F.lit("n"), n.cast("string")).alias("fields"))
    rows.write.parquet(f"{path}/in")
    held = store.Store(spark, f"{path}/store")
    log_stream.applied(log_stream.action_rows(spark, f"{path}/in"), held, f"{path}/checkpoint").awaitTermination()
    return _lines(held.records())


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

