"""Queries that apply the operators to the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import core as c
from tallyforge.operators import dedup, emit, ledger, reports, resolve, rules, validate
from tallyforge.sources import tickets as ticket_sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- projections and scalar functions


@query("prj_01", "SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') AS reg_key FROM part")
def prj_01(s, d):
    return t(s, d, "part").select("p_partkey", c.reg_key("p_name").alias("reg_key"))


PLATE = "concat(chr(CAST(65 + s_suppkey % 26 AS INTEGER)), 'P', lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0'), 'Q', lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0'))"


def plates(s, d):
    k = F.col("s_suppkey")
    return t(s, d, "supplier").withColumn("plate", F.concat(F.char(65 + k % 26), F.lit("P"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("Q"), F.lpad((k % 10000).cast("string"), 4, "0")))


@query("prj_02", f"SELECT s_suppkey, regexp_replace({PLATE}, '^([A-Z]{{2}})([0-9]{{2}})([A-Z]{{1,3}})([0-9]{{4}})$', '\\1-\\2-\\3-\\4') AS display FROM supplier")
def prj_02(s, d):
    return plates(s, d).select("s_suppkey", c.reg_display("plate").alias("display"))


@query("prj_03", "SELECT o_orderkey, concat('orders.csv#row', o_orderkey) AS citation FROM orders")
def prj_03(s, d):
    return t(s, d, "orders").select("o_orderkey", c.cite(F.lit("orders.csv"), F.concat(F.lit("row"), F.col("o_orderkey"))).alias("citation"))


@query("prj_04", "SELECT o_orderkey, regexp_replace(lower(o_orderpriority), '[^a-z0-9]', '', 'g') AS k FROM orders")
def prj_04(s, d):
    return t(s, d, "orders").select("o_orderkey", c.norm_key("o_orderpriority").alias("k"))


ALIASES = {"amount": "value k amt"}


@query("prj_05", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS amount FROM events")
def prj_05(s, d):
    entries = F.map_entries(F.from_json("props", "map<string,string>"))
    return t(s, d, "events").select("event_id", ticket_sources.field(entries, "amount", ALIASES).alias("amount"))


@query("prj_07", """SELECT o_orderkey, CASE split_part(o_orderpriority, '-', 1) WHEN '1' THEN 'HIGH' WHEN '2' THEN 'MEDIUM' WHEN '3' THEN 'HIGH'
    ELSE upper(split_part(o_orderpriority, '-', 1)) END AS severity FROM orders""")
def prj_07(s, d):
    return t(s, d, "orders").select("o_orderkey", c.severity(F.split_part("o_orderpriority", F.lit("-"), F.lit(1))).alias("severity"))


@query("prj_08", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00'
    WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M') || ':00' WHEN 3 THEN CASE WHEN epoch(o_orderdate) >= 1000000000 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END END AS iso,
    o_orderkey % 5 < 3 OR (o_orderkey % 5 = 3 AND epoch(o_orderdate) >= 1000000000) AS ok, ['iso', 'iso_date_only', 'dd/mm/yyyy', CASE WHEN epoch(o_orderdate) >= 1000000000 THEN 'epoch_s' ELSE 'unparseable' END, 'unparseable'][CAST(o_orderkey % 5 AS INTEGER) + 1] AS form
    FROM orders""")
def prj_08(s, d):
    o = t(s, d, "orders").withColumn("i", F.col("o_orderkey") % 5)
    fmt = lambda f: F.date_format("o_orderdate", f)
    epoch = F.unix_timestamp("o_orderdate")
    raw = F.when(F.col("i") == 0, fmt("yyyy-MM-dd HH:mm:ss")).when(F.col("i") == 1, fmt("yyyy-MM-dd")).when(F.col("i") == 2, fmt("d/M/yyyy H:mm")).when(F.col("i") == 3, epoch.cast("string")).otherwise("next Tuesday")
    return o.select("o_orderkey", c.timestamp_of(raw).alias("x")).select("o_orderkey", "x.iso", "x.ok", "x.form")


@query("prj_09", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS km FROM part")
def prj_09(s, d):
    return t(s, d, "part").select("p_partkey", c.kilometres(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" km"))).alias("km"))


NOTE = "CASE l_returnflag WHEN 'R' THEN 'Temporary fix applied, needs permanent repair' WHEN 'A' THEN 'Brake pad replaced, road test OK' ELSE 'oil change' END"


def notes(s, d):
    flag = F.col("l_returnflag")
    return t(s, d, "lineitem").withColumn("note", F.when(flag == "R", "Temporary fix applied, needs permanent repair").when(flag == "A", "Brake pad replaced, road test OK").otherwise("oil change"))


@query("prj_10", f"""WITH n AS (SELECT l_suppkey, lower({NOTE}) AS n FROM lineitem)
    SELECT l_suppkey, sum(CAST(n LIKE '%temporary fix%' AS INTEGER))::BIGINT AS jugaad, sum(CAST(n LIKE '%brake%' AS INTEGER))::BIGINT AS brake_work,
           sum(CAST(n LIKE '%replaced%' AS INTEGER))::BIGINT AS permanent_repair, sum(CAST(n LIKE '%road test ok%' AS INTEGER))::BIGINT AS road_tested FROM n GROUP BY 1""")
def prj_10(s, d):
    flags = c.note_flags("note")
    return notes(s, d).groupBy("l_suppkey").agg(*(F.count_if(flags[k]).alias(k) for k in ("jugaad", "brake_work", "permanent_repair", "road_tested")))


ISSUES = (("AIR", "DEGRADED", "ROADSIDE"), ("click", "DEGRADED", "ROADSIDE"), ("error", "SAFETY_CRITICAL", "TOW"), ("purchase", "IMMOBILISING", "TOW"))


@query("prj_11", """SELECT event_id, CASE event_type WHEN 'click' THEN 'DEGRADED' WHEN 'error' THEN 'SAFETY_CRITICAL' WHEN 'purchase' THEN 'IMMOBILISING' ELSE 'UNSPECIFIED' END AS class,
    CASE event_type WHEN 'click' THEN 'ROADSIDE' ELSE 'TOW' END AS recovery, event_type IN ('click', 'error', 'purchase') AS known FROM events""")
def prj_11(s, d):
    dim = s.createDataFrame(ISSUES, "issue string, class string, recovery string")  # a configured table of a few rows
    out = t(s, d, "events").join(F.broadcast(dim), F.lower(F.trim("event_type")) == F.col("issue"), "left")
    return out.select("event_id", F.coalesce("class", F.lit("UNSPECIFIED")).alias("class"), F.coalesce("recovery", F.lit("TOW")).alias("recovery"), F.col("issue").isNotNull().alias("known"))


@query("prj_13", "SELECT o_orderkey, month(o_orderdate) AS month, hour(o_orderdate) AS hour FROM orders".replace("month(o_orderdate)", "CAST(month(o_orderdate) AS BIGINT)").replace("hour(o_orderdate)", "CAST(hour(o_orderdate) AS BIGINT)"))
def prj_13(s, d):
    return t(s, d, "orders").select("o_orderkey", F.month("o_orderdate").cast("bigint").alias("month"), F.hour("o_orderdate").cast("bigint").alias("hour"))


@query("prj_14", "SELECT o_orderkey, 'WO-' || upper(substr(sha256('wo:' || o_orderkey), 1, 10)) AS work_order_id, 'MSG-' || upper(substr(sha256('msg:' || o_orderkey), 1, 10)) AS message_id FROM orders")
def prj_14(s, d):
    k = F.col("o_orderkey").cast("string")
    return t(s, d, "orders").select("o_orderkey", c.prefixed_id("WO-", "wo", k).alias("work_order_id"), c.prefixed_id("MSG-", "msg", k).alias("message_id"))


@query("prj_16", """SELECT o_orderkey, 'Order ' || o_orderkey || chr(10) || chr(10) || CASE WHEN o_orderstatus = 'F' THEN 'It is filled.' || chr(10) ELSE '' END ||
    CASE WHEN o_totalprice > 200000 THEN 'A large one.' || chr(10) ELSE '' END || 'Thank you.' AS body FROM orders""")
def prj_16(s, d):
    lines = [F.concat(F.lit("Order "), F.col("o_orderkey")), F.lit(""), F.when(F.col("o_orderstatus") == "F", "It is filled."), F.when(F.col("o_totalprice") > 200000, "A large one."), F.lit("Thank you.")]
    return t(s, d, "orders").select("o_orderkey", emit.message(lines).alias("body"))


STEPS = "list_filter([CASE WHEN o_orderstatus = 'F' THEN 'tow' ELSE 'roadside' END, CASE WHEN o_totalprice > 200000 THEN 'hold' END, 'inform'], lambda x: x IS NOT NULL)"


@query("prj_17", f"WITH a AS (SELECT o_orderkey, {STEPS} AS s FROM orders) SELECT o_orderkey, CAST(unnest(range(1, len(s) + 1)) AS BIGINT) AS step, unnest(s) AS action FROM a")
def prj_17(s, d):
    steps = emit.numbered([F.when(F.col("o_orderstatus") == "F", "tow").otherwise("roadside"), F.when(F.col("o_totalprice") > 200000, "hold"), F.lit("inform")])
    return t(s, d, "orders").select("o_orderkey", F.explode(steps).alias("x")).select("o_orderkey", F.col("x.step").cast("bigint").alias("step"), "x.action")


@query("str_02", "SELECT p_partkey, regexp_extract(p_name, '(?i)([a-z]+)', 1) AS word, CAST(len(regexp_extract_all(p_name, '[A-Za-z]+')) AS BIGINT) AS n FROM part")
def str_02(s, d):
    return t(s, d, "part").select("p_partkey", F.regexp_extract("p_name", "(?i)([a-z]+)", 1).alias("word"), F.size(F.regexp_extract_all("p_name", F.lit("[A-Za-z]+"), F.lit(0))).cast("bigint").alias("n"))


FINGERPRINT = "sha256(lower(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'))))"


@query("str_03", f"SELECT doc_id, {FINGERPRINT} AS fingerprint FROM documents")
def str_03(s, d):
    return t(s, d, "documents").select("doc_id", c.fingerprint("text").alias("fingerprint"))


TOKENS = "list_distinct(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 2 AND w NOT IN (" + ", ".join(f"'{w}'" for w in c.STOPWORDS) + ")))"


@query("str_04", f"SELECT conv_id, turn, CAST(len({TOKENS.format('text')}) AS BIGINT) AS n_tokens, array_to_string(list_sort({TOKENS.format('text')}), ' ') AS tokens FROM conversations")
def str_04(s, d):
    tokens = c.subject_tokens("text")
    return t(s, d, "conversations").select("conv_id", "turn", F.size(tokens).cast("bigint").alias("n_tokens"), F.array_join(F.array_sort(tokens), " ").alias("tokens"))


@query("str_05", """WITH p AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(p_type, ' ')) AS b FROM part)
    SELECT p_partkey, CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) AS similarity FROM p""")
def str_05(s, d):
    a, b = (F.array_distinct(F.split(x, " ")) for x in ("p_name", "p_type"))
    return t(s, d, "part").select("p_partkey", c.jaccard(a, b).alias("similarity"))


@query("str_06", "SELECT c_custkey, substr(sha256(c_name), 1, 16) AS h FROM customer")
def str_06(s, d):
    return t(s, d, "customer").select("c_custkey", c.short_hash("c_name").alias("h"))


@query("str_07", """SELECT l_orderkey, l_linenumber, substr(sha256('q=' || CASE WHEN l_quantity = floor(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE CAST(l_quantity AS VARCHAR) END || '|f=' || l_returnflag || '|s=' || l_linestatus), 1, 16) AS h
    FROM lineitem""")
def str_07(s, d):
    h = c.material_hash({"q": c.js_number("l_quantity"), "f": F.col("l_returnflag"), "s": F.col("l_linestatus")})
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", h.alias("h"))


@query("str_08", "SELECT doc_id, CAST((lang IS NOT NULL AND lang <> '')::INT + (source IS NOT NULL AND source <> 'src1' AND source <> '')::INT + (text IS NOT NULL AND text <> '')::INT AS BIGINT) AS n FROM documents")
def str_08(s, d):
    fields = [F.col("lang"), F.when(F.col("source") != "src1", F.col("source")), F.col("text")]
    return t(s, d, "documents").select("doc_id", c.completeness(fields).cast("bigint").alias("n"))


@query("str_11", "SELECT n_nationkey, regexp_replace(n_name, '^(FRANCE|GERMANY|CHINA)$', '[REDACTED:PERSON]') AS masked FROM nation")
def str_11(s, d):
    return t(s, d, "nation").select("n_nationkey", c.redact("n_name", names=("France", "germany", "China"))["text"].alias("masked"))


@query("str_12", "SELECT n_nationkey, substr(n_name, 1, 1) || repeat('*', length(n_name) - 1) AS preview FROM nation")
def str_12(s, d):
    return t(s, d, "nation").select("n_nationkey", c.preview("n_name").alias("preview"))


@query("dat_01", "SELECT l_orderkey, l_linenumber, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS BIGINT) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def dat_01(s, d):
    return t(s, d, "lineitem").join(t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", c.days_between("o_orderdate", "l_shipdate").cast("bigint").alias("days"))


@query("dat_02", "SELECT o_orderkey, CAST(12 * (2000 - year(o_orderdate)) + 2 - month(o_orderdate) - CAST(15 < day(o_orderdate) AS INTEGER) AS BIGINT) AS months FROM orders")
def dat_02(s, d):
    return t(s, d, "orders").select("o_orderkey", c.months_between("o_orderdate", F.lit("2000-02-15")).cast("bigint").alias("months"))


@query("mth_01", "SELECT p_partkey, CAST(ceil(CAST(p_size AS DOUBLE) * 1.2) AS BIGINT) AS hours FROM part")
def mth_01(s, d):
    return t(s, d, "part").select("p_partkey", c.padded_hours("p_size", 20).alias("hours"))


@query("mth_02", "SELECT s_suppkey, CAST(round(100 * CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) / count(*)) AS BIGINT) AS pct FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def mth_02(s, d):
    li = t(s, d, "lineitem").join(t(s, d, "supplier").select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return li.groupBy("s_suppkey").agg(F.round(100 * F.count_if(F.col("l_returnflag") == "R").cast("double") / F.count("*")).cast("bigint").alias("pct"))


@query("arr_01", "WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) SELECT p_partkey, array_to_string(list_transform(list_filter(w, lambda x: length(x) > 4), lambda x: upper(x)), ',') AS long_words, len(list_filter(w, lambda x: length(x) > 6)) > 0 AS any_long FROM p")
def arr_01(s, d):
    w = F.split("p_name", " ")
    return t(s, d, "part").select("p_partkey", F.array_join(F.transform(F.filter(w, lambda x: F.length(x) > 4), F.upper), ",").alias("long_words"), F.exists(w, lambda x: F.length(x) > 6).alias("any_long"))


@query("map_01", "SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A')::BIGINT AS a, count(*) FILTER (l_returnflag = 'N')::BIGINT AS n, count(*) FILTER (l_returnflag = 'R')::BIGINT AS r FROM lineitem GROUP BY 1")
def map_01(s, d):
    by_flag = t(s, d, "lineitem").groupBy("l_suppkey", "l_returnflag").count().groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "count"))).alias("m"))
    return by_flag.select("l_suppkey", *(F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0)).alias(k.lower()) for k in "ANR"))


@query("jsn_01", """SELECT r_regionkey, '{"a":null,"key":' || r_regionkey || ',"name":"' || r_name || '"}' AS row FROM region""")
def jsn_01(s, d):
    df = t(s, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key"), F.lit(None).cast("string").alias("a"))
    return df.select(F.col("key").alias("r_regionkey"), emit.sorted_json(df).alias("row"))


@query("hof_01", "SELECT doc_id, coalesce(nullif(source, 'src0'), 'unknown') AS source FROM documents")
def hof_01(s, d):
    return t(s, d, "documents").select("doc_id", F.coalesce(c.blank_to_null(F.regexp_replace("source", "^src0$", "")), F.lit("unknown")).alias("source"))


@query("src_16", "SELECT page_id, sha256(html) AS digest FROM pages")
def src_16(s, d):
    return t(s, d, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))


# ---- filters


@query("flt_01", "SELECT count(*) FILTER (doc_id IS NOT NULL AND text <> '')::BIGINT AS kept, count(*) FILTER (doc_id IS NULL OR text IS NULL OR text = '')::BIGINT AS rejected FROM documents")
def flt_01(s, d):
    good = F.coalesce(F.col("doc_id").isNotNull() & (F.col("text") != ""), F.lit(False))
    return t(s, d, "documents").agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("rejected"))


def tickets(s, d) -> DataFrame:
    """Orders as tickets, some of them broken."""
    o = t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("idx"), F.when(k % 23 != 0, F.concat(F.lit("T-"), k)).alias("ticket_id"), F.when(k % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon").alias("created_at"),
        F.when(k % 11 != 0, F.concat(F.lit("v-"), k % 150)).alias("vehicle"), F.when(k % 3 == 0, F.concat(F.lit("D"), k % 40)).alias("driver_id"),
        F.when(k % 13 == 0, F.lit("Atlantis")).otherwise(F.concat(F.lit("hub"), F.col("c_nationkey"))).alias("origin_hub"), F.when(k % 17 != 0, (k % 100).cast("double") - 5).alias("km_from_origin_hub"),
        F.when(k % 19 != 0, F.lit("hub1")).alias("destination"), F.lit("tyre burst").alias("issue"), F.when(k % 5 == 0, F.lit("SEVERE")).otherwise(F.lit("HIGH")).alias("severity"), F.col("c_mktsegment").alias("client"),
    )


def dimensions(s, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    vehicles = s.range(100).select(F.concat(F.lit("V"), F.col("id")).alias("reg_key"))
    return vehicles, t(s, d, "nation").select(F.concat(F.lit("hub"), F.col("n_nationkey")).alias("hub")), s.range(30).select(F.concat(F.lit("D"), F.col("id")).alias("driver_id")), t(s, d, "customer").select(F.col("c_mktsegment").alias("client")).filter("client <> 'MACHINERY'").distinct()


REASON_SQL = """array_to_string(list_filter([CASE WHEN k % 23 = 0 THEN 'MISSING_TICKET_ID' END, CASE WHEN k % 7 = 0 THEN 'UNPARSEABLE_TIMESTAMP' END, CASE WHEN k % 11 = 0 THEN 'MISSING_VEHICLE' END,
    CASE WHEN k % 11 <> 0 AND k % 150 >= 100 THEN 'UNKNOWN_VEHICLE' END, CASE WHEN k % 13 <> 0 AND c_nationkey IS NULL THEN 'MISSING_ORIGIN_HUB' END, CASE WHEN k % 13 = 0 THEN 'UNKNOWN_ORIGIN_HUB' END,
    CASE WHEN k % 17 = 0 THEN 'MISSING_DISTANCE' END, CASE WHEN k % 17 <> 0 AND k % 100 < 5 THEN 'INVALID_DISTANCE' END, CASE WHEN k % 19 = 0 THEN 'MISSING_DESTINATION' END], lambda x: x IS NOT NULL), ',')"""
O_SQL = "o AS (SELECT o_orderkey AS k, orders.*, customer.* FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"


def checked(s, d) -> DataFrame:
    return validate.looked_up(tickets(s, d), *dimensions(s, d))


# vehicle keys keep no dash: 'v-12' is V12; those below 100 are known


@query("flt_02", f"WITH {O_SQL} SELECT k AS idx, {REASON_SQL} AS reasons FROM o")
def flt_02(s, d):
    return checked(s, d).select("idx", F.array_join(validate.reasons(), ",").alias("reasons"))


@query("flt_03", f"""WITH {O_SQL} SELECT k AS idx, array_to_string(list_filter([CASE WHEN k % 3 = 0 AND k % 40 >= 30 THEN 'UNKNOWN_DRIVER' END, CASE WHEN k % 5 = 0 THEN 'UNKNOWN_SEVERITY' END,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'UNKNOWN_CLIENT' END], lambda x: x IS NOT NULL), ',') AS findings FROM o""")
def flt_03(s, d):
    return checked(s, d).select("idx", F.array_join(validate.findings(), ",").alias("findings"))


@query("flt_07", "SELECT event_id, hour(ts) >= 20 OR hour(ts) < 6 AS overnight, hour(ts) >= 8 AND hour(ts) < 18 AS gate, hour(ts) >= 21 OR hour(ts) < 5 AS night FROM events")
def flt_07(s, d):
    h = F.hour("ts")
    return t(s, d, "events").select("event_id", c.in_hours(h, 20, 6).alias("overnight"), c.in_hours(h, 8, 18).alias("gate"), c.in_hours(h, 21, 5).alias("night"))


@query("flt_04", "SELECT o_orderkey, n_name IN ('FRANCE', 'GERMANY') OR r_name = 'ASIA' AS touches FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def flt_04(s, d):
    o = t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.select("o_orderkey", rules.touches(F.col("n_name"), F.col("r_name"), ("FRANCE", "GERMANY", "ASIA")).alias("touches"))


@query("flt_05", "SELECT o_orderkey FROM orders WHERE month(o_orderdate) IN (10, 11, 12, 1, 2)")
def flt_05(s, d):
    return t(s, d, "orders").filter(rules.in_season(F.col("o_orderdate"), (10, 11, 12, 1, 2))).select("o_orderkey")


@query("flt_06", "SELECT l_suppkey, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1997-06-30 23:59:59' OR l_shipdate IS NULL GROUP BY 1")
def flt_06(s, d):
    return t(s, d, "lineitem").filter("l_shipdate is null or l_shipdate <= timestamp '1997-06-30 23:59:59'").groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("flt_08", "SELECT c_custkey FROM customer WHERE c_mktsegment IS NOT NULL AND c_mktsegment NOT IN ('', 'BUILDING')")
def flt_08(s, d):
    return t(s, d, "customer").filter(F.col("c_mktsegment").isNotNull() & ~F.col("c_mktsegment").isin("", "BUILDING")).select("c_custkey")


@query("flt_10", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '00001')")
def flt_10(s, d):
    return reports.search(t(s, d, "customer"), "c_name", "00001").select("c_custkey")


# ---- joins


@query("join_01", """SELECT count(*) FILTER (s_suppkey IS NOT NULL)::BIGINT AS attached, count(*) FILTER (s_suppkey IS NULL)::BIGINT AS orphans
    FROM lineitem LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 <> 3) ON l_suppkey = s_suppkey""")
def join_01(s, d):
    known, li = t(s, d, "supplier").filter("s_suppkey % 10 <> 3").select("s_suppkey"), t(s, d, "lineitem").select("l_suppkey")
    return li.join(known, F.col("l_suppkey") == F.col("s_suppkey"), "left").agg(F.count_if(F.col("s_suppkey").isNotNull()).alias("attached"), F.count_if(F.col("s_suppkey").isNull()).alias("orphans"))


@query("join_02", "SELECT c_custkey, coalesce(n, 0)::BIGINT AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def join_02(s, d):
    n = t(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t(s, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("join_07", """WITH p AS (SELECT o_orderkey, o_custkey % 100 AS k, o_orderdate FROM orders), e AS (SELECT l_suppkey % 100 AS k, l_shipdate, l_returnflag FROM lineitem)
    SELECT o_orderkey, strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') AS last_visit, strftime(max(l_shipdate) FILTER (l_returnflag = 'R'), '%Y-%m-%d %H:%M:%S') AS last_fix
    FROM p LEFT JOIN e ON p.k = e.k AND l_shipdate <= o_orderdate GROUP BY 1""")
def join_07(s, d):
    probes = t(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("k"), "o_orderdate")
    events = t(s, d, "lineitem").select((F.col("l_suppkey") % 100).alias("k"), "l_shipdate", "l_returnflag")
    out = resolve.as_of_state(probes, events, "k", "o_orderdate", "l_shipdate", {"last_visit": F.lit(True), "last_fix": F.col("l_returnflag") == "R"})
    return out.select("o_orderkey", *(F.date_format(x, "yyyy-MM-dd HH:mm:ss").alias(x) for x in ("last_visit", "last_fix")))


@query("join_10", "SELECT a.n_nationkey, b.n_nationkey AS other, row_number() OVER (PARTITION BY a.n_nationkey ORDER BY abs(a.n_nationkey - b.n_nationkey), b.n_name) AS place FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def join_10(s, d):
    from pyspark.sql import Window

    n = t(s, d, "nation")
    b = n.select(F.col("n_nationkey").alias("other"), F.col("n_name").alias("o_name"), "n_regionkey")
    pairs = n.select("n_nationkey", "n_regionkey").join(b, "n_regionkey").filter("n_nationkey <> other")
    return pairs.select("n_nationkey", "other", F.row_number().over(Window.partitionBy("n_nationkey").orderBy(F.abs(F.col("n_nationkey") - F.col("other")), "o_name")).cast("bigint").alias("place"))


@query("agg_14", """WITH a AS (SELECT l_suppkey % 12 AS rule_id, l_orderkey, CASE l_returnflag WHEN 'A' THEN 'PASS' WHEN 'R' THEN 'FAIL' ELSE 'NOT_APPLICABLE' END AS verdict FROM lineitem), r AS (SELECT unnest(range(14)) AS rule_id)
    SELECT r.rule_id, count(*) FILTER (verdict = 'PASS')::BIGINT AS pass, count(*) FILTER (verdict = 'FAIL')::BIGINT AS fail, count(*) FILTER (verdict = 'NOT_APPLICABLE')::BIGINT AS not_applicable,
           count(DISTINCT CASE WHEN verdict <> 'NOT_APPLICABLE' THEN l_orderkey END)::BIGINT AS affected FROM r LEFT JOIN a USING (rule_id) GROUP BY 1""")
def agg_14(s, d):
    verdict = F.when(F.col("l_returnflag") == "A", "PASS").when(F.col("l_returnflag") == "R", "FAIL").otherwise("NOT_APPLICABLE")
    audit = t(s, d, "lineitem").select((F.col("l_suppkey") % 12).alias("rule_id"), "l_orderkey", verdict.alias("verdict"))
    return reports.verdict_breakdown(audit, s.range(14).withColumnRenamed("id", "rule_id"), "rule_id", "verdict", "l_orderkey", ("PASS", "FAIL", "NOT_APPLICABLE"))


@query("join_14", "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 <> 0")
def join_14(s, d):
    o = t(s, d, "orders").select("o_orderkey")
    _, held = ledger.merge(o.filter("o_orderkey % 4 = 0"), o.filter("o_orderkey % 3 = 0"), o.filter("o_orderkey % 2 = 0"), o, "o_orderkey")
    return held


# ---- aggregations and ordered operators


@query("agg_01", """WITH r AS (SELECT conv_id, turn, role, nullif(text, '') AS text FROM conversations)
    SELECT conv_id, min_by(role, turn) FILTER (role = 'user') AS user_role, min_by(text, turn) FILTER (text IS NOT NULL) AS text, count(*)::BIGINT AS source_rows FROM r GROUP BY 1""")
def agg_01(s, d):
    rows = t(s, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("role")).alias("user_role"), c.blank_to_null("text").alias("text"))
    return resolve.merge_with_precedence(rows, "conv_id", [F.col("turn")], ["user_role", "text"])


@query("agg_02", """WITH l AS (SELECT o_custkey % 50 AS k, 'status' AS field, o_orderstatus AS value FROM orders UNION ALL SELECT o_custkey % 50, 'priority', o_orderpriority FROM orders)
    SELECT k, field, count(DISTINCT value)::BIGINT AS n_values, array_to_string(list_sort(list(DISTINCT value)), '|') AS "values" FROM l GROUP BY 1, 2 HAVING count(DISTINCT value) > 1""")
def agg_02(s, d):
    rows = t(s, d, "orders").select((F.col("o_custkey") % 50).alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return resolve.conflicts(rows, "k", ["status", "priority"])


@query("agg_03", """SELECT l_suppkey, count(*)::BIGINT AS n_events, strftime(max(l_shipdate), '%Y-%m-%d') AS last_at, arg_max(l_quantity, (l_shipdate, l_quantity)) AS last_value FROM lineitem GROUP BY 1""")
def agg_03(s, d):
    return resolve.event_rollup(t(s, d, "lineitem"), "l_suppkey", "l_shipdate", "l_quantity").withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd"))


@query("agg_05", """SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (event_type IN ('error', 'purchase')) = 'error' AS is_open, strftime(max(ts) FILTER (event_type = 'error'), '%Y-%m-%d %H:%M:%S') AS last_open_at
    FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1""")
def agg_05(s, d):
    out = resolve.open_state(t(s, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "purchase")
    return out.withColumn("last_open_at", F.date_format("last_open_at", "yyyy-MM-dd HH:mm:ss"))


@query("agg_06", "SELECT l_suppkey, count(*)::BIGINT AS total, count(*) FILTER (l_returnflag = 'R')::BIGINT AS returned, count(*) FILTER (l_linestatus = 'O')::BIGINT AS open, strftime(min(l_shipdate), '%Y-%m-%d') AS first_at, strftime(max(l_shipdate), '%Y-%m-%d') AS last_at FROM lineitem GROUP BY 1")
def agg_06(s, d):
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    return t(s, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_linestatus") == "O").alias("open"), day(F.min("l_shipdate")).alias("first_at"), day(F.max("l_shipdate")).alias("last_at"))


@query("agg_08", f"""SELECT {FINGERPRINT} AS fp, count(*)::BIGINT AS occurrences, count(DISTINCT text)::BIGINT AS n_contents,
    concat_ws(',', CASE WHEN count(DISTINCT lang) > 1 THEN 'lang' END, CASE WHEN count(DISTINCT source) > 1 THEN 'source' END) AS differing FROM documents GROUP BY 1""")
def agg_08(s, d):
    return dedup.group_stats(t(s, d, "documents").withColumn("fp", c.fingerprint("text")), "fp", F.col("text"), ["lang", "source"])


@query("agg_12", "SELECT count(*)::BIGINT AS total, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS filled, count(*) FILTER (o_totalprice > 200000)::BIGINT AS large FROM orders")
def agg_12(s, d):
    return reports.kpis(t(s, d, "orders"), filled=F.col("o_orderstatus") == "F", large=F.col("o_totalprice") > 200000)


@query("agg_18", """WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]{2,}')) AS word FROM conversations) SELECT word, count(*)::BIGINT AS n FROM w WHERE lower(word) NOT IN ('the', 'and') GROUP BY 1""")
def agg_18(s, d):
    words = t(s, d, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{2,}"), F.lit(0))).alias("word"))
    return words.filter(~F.lower("word").isin("the", "and")).groupBy("word").agg(F.count("*").alias("n"))


@query("agg_19", """WITH r AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events), u AS (SELECT user_id, max(CAST(value < previous AS INTEGER)) AS reg FROM r GROUP BY 1)
    SELECT count(*)::BIGINT AS keys, sum(coalesce(reg, 0))::BIGINT AS regressing, CAST(sum(coalesce(reg, 0)) AS DOUBLE) / count(*) > 0.4 AS systemic FROM u""")
def agg_19(s, d):
    e = t(s, d, "events")
    bad = resolve.regressions(e, "user_id", ["ts", "event_id"], "value").select("user_id").distinct().withColumn("reg", F.lit(1))
    return e.select("user_id").distinct().join(bad, "user_id", "left").agg(F.count("*").alias("keys"), F.sum(F.coalesce("reg", F.lit(0))).cast("bigint").alias("regressing")).withColumn("systemic", F.col("regressing") / F.col("keys") > 0.4)


@query("agg_22", "SELECT strftime(greatest((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)), '%Y-%m-%d') AS latest")
def agg_22(s, d):
    return t(s, d, "orders").select(F.col("o_orderdate").alias("x")).unionByName(t(s, d, "lineitem").select(F.col("l_shipdate").alias("x"))).agg(F.date_format(F.max("x"), "yyyy-MM-dd").alias("latest"))


@query("agg_11", "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags FROM lineitem GROUP BY 1")
def agg_11(s, d):
    return t(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))


@query("agg_17", "SELECT array_to_string(list_sort(list(DISTINCT k)), ',') AS fields FROM (SELECT unnest(json_keys(props)) AS k FROM events)")
def agg_17(s, d):
    return t(s, d, "events").select(F.explode(F.json_object_keys("props")).alias("k")).agg(F.array_join(F.array_sort(F.collect_set("k")), ",").alias("fields"))


@query("win_02", "WITH r AS (SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events WHERE value IS NOT NULL) SELECT event_id, user_id, value, previous FROM r WHERE value < previous")
def win_02(s, d):
    return resolve.regressions(t(s, d, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "user_id", "value", "previous")


@query("win_03", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1")
def win_03(s, d):
    return t(s, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


@query("win_08", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type FROM events GROUP BY 1")
def win_08(s, d):
    return t(s, d, "events").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"))


BEST_SQL = f"""WITH f AS (SELECT {FINGERPRINT} AS fingerprint, doc_id, n_chars FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY n_chars DESC, doc_id) AS nth, count(*) OVER (PARTITION BY fingerprint) AS occurrences FROM f)
    SELECT fingerprint, doc_id, occurrences::BIGINT AS occurrences FROM r WHERE nth = 1"""
@query("dup_01", BEST_SQL)
def dup_01(s, d):
    docs = t(s, d, "documents").select(c.fingerprint("text").alias("fingerprint"), "doc_id", "n_chars")
    return docs.groupBy("fingerprint").agg(F.min_by("doc_id", F.struct(-F.col("n_chars"), "doc_id")).alias("doc_id"), F.count("*").alias("occurrences"))


# ---- sorts, limits, sets


@query("srt_03", "SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey, s_name) AS place FROM supplier")
def srt_03(s, d):
    ranked = t(s, d, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    other = ranked.groupBy("s_nationkey").count().orderBy("s_nationkey")
    from pyspark.sql import Window

    before = other.select("s_nationkey", (F.sum("count").over(Window.orderBy("s_nationkey")) - F.col("count")).alias("before"))  # one row a nation
    return ranked.join(F.broadcast(before), "s_nationkey").select("s_suppkey", (F.col("before") + F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_name"))).cast("bigint").alias("place"))


@query("lim_01", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
def lim_01(s, d):
    return t(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(40)


@query("set_01", "SELECT DISTINCT source FROM documents")
def set_01(s, d):
    return t(s, d, "documents").select("source").distinct()


@query("set_02", "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier")
def set_02(s, d):
    return t(s, d, "customer").select(F.col("c_name").alias("name")).unionByName(t(s, d, "supplier").select(F.col("s_name").alias("name")))


@query("set_03", "SELECT x FROM (SELECT c_mktsegment AS x FROM customer UNION SELECT o_orderpriority FROM orders) WHERE x NOT IN ('BUILDING')")
def set_03(s, d):
    return t(s, d, "customer").select(F.col("c_mktsegment").alias("x")).union(t(s, d, "orders").select("o_orderpriority")).distinct().join(s.createDataFrame([("BUILDING",)], "x string"), "x", "left_anti")


@query("set_04", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def set_04(s, d):
    return ledger.new_rows(t(s, d, "customer").select("c_custkey"), t(s, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


SETS_SQL = f"r AS (SELECT doc_id, lang, list_sort({TOKENS.format('text')}) AS w FROM documents), k AS (SELECT min(doc_id) AS doc_id, lang, w FROM r WHERE len(w) > 0 GROUP BY lang, w)"


def token_rows(s, d):
    return t(s, d, "documents").select("doc_id", "lang", c.subject_tokens("text").alias("tokens"))


@query("dup_02", f"""WITH {SETS_SQL}, p AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS n, len(b.w) AS m
    FROM k a JOIN k b ON a.lang = b.lang AND a.doc_id < b.doc_id AND least(len(a.w), len(b.w)) >= 0.85 * greatest(len(a.w), len(b.w))) SELECT id_a, id_b, round(CAST(i AS DOUBLE) / (n + m - i), 6) AS similarity FROM p WHERE CAST(i AS DOUBLE) / (n + m - i) >= 0.85""")
def dup_02(s, d):
    """Pairs of the different token sets of a language, each named by its smallest document."""
    return dedup.near_pairs(token_rows(s, d), "lang", "doc_id", "tokens", 0.85)[0].withColumn("similarity", F.round("similarity", 6))


@query("dup_02_members", f"WITH {SETS_SQL} SELECT r.doc_id AS id, coalesce(k.doc_id, r.doc_id) AS rep FROM r LEFT JOIN k ON r.lang = k.lang AND r.w = k.w")
def dup_02_members(s, d):
    return dedup.set_members(token_rows(s, d), "lang", "doc_id", "tokens")[1]


@query("dup_02_clusters")
def dup_02_clusters(s, d):
    """Greedy clusters depend on order; tests hold them against a plain fold."""
    return dedup.near_clusters(token_rows(s, d), "lang", "doc_id", "tokens", 0.85)


# ---- ledger


@query("led_01", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'first' ELSE 'second' END AS origin FROM orders")
def led_01(s, d):
    o = t(s, d, "orders").select("o_orderkey")
    first, second = o.filter("o_orderkey % 2 = 0").withColumn("origin", F.lit("first")), o.withColumn("origin", F.lit("second"))
    merged, _ = ledger.merge(first, o.limit(0), second, o.limit(0), "o_orderkey")
    again, _ = ledger.merge(merged, o.limit(0), second.withColumn("origin", F.lit("third")), o.limit(0), "o_orderkey")
    return again


@query("led_02", "SELECT o_orderkey, o_orderkey % 4 = 0 OR o_orderkey % 6 = 0 AS sent, CASE WHEN o_orderkey % 4 = 0 THEN 'old' WHEN o_orderkey % 6 = 0 THEN 'new' END AS approved_by FROM orders")
def led_02(s, d):
    o = t(s, d, "orders").select("o_orderkey")
    old = F.col("o_orderkey") % 4 == 0
    acc = o.select("o_orderkey", *(F.when(old, v).alias(k) for k, v in (("approved_by", "old"), ("sent_at", "t0"), ("recipient", "r"), ("body", "b"))))
    approvals = o.filter("o_orderkey % 6 = 0").select("o_orderkey", F.lit("new").alias("approved_by"), F.lit("t1").alias("sent_at"), F.lit("r").alias("recipient"), F.lit("b").alias("body"))
    return ledger.mark_sent(acc, approvals, "o_orderkey").select("o_orderkey", "sent", "approved_by")


# ---- rules over orders

SIMPLE_RULES = {
    "rule_001": ("CASE WHEN NOT (month(o_orderdate) IN (10, 11, 12, 1, 2) AND o_orderstatus = 'F') THEN 'NOT_APPLICABLE' WHEN o_orderkey % 4 = 0 THEN 'INSUFFICIENT_DATA' WHEN o_orderkey % 4 = 1 THEN 'PASS' ELSE 'FAIL' END",
                 lambda: rules.required_value(rules.in_season(F.col("o_orderdate"), (10, 11, 12, 1, 2)) & (F.col("o_orderstatus") == "F"), F.when(F.col("o_orderkey") % 4 == 1, "BS6").when(F.col("o_orderkey") % 4 > 1, "BS4"), "BS6")),
    "rule_002": ("CASE WHEN NOT month(o_orderdate) IN (11, 12, 1, 2) THEN 'NOT_APPLICABLE' WHEN o_orderkey % 3 = 0 THEN 'INSUFFICIENT_DATA' WHEN o_orderkey % 3 = 1 THEN 'PASS' ELSE 'FAIL' END",
                 lambda: rules.required_flag(rules.in_season(F.col("o_orderdate"), (11, 12, 1, 2)), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 3 == 1))),
    "rule_005": ("CASE WHEN c_mktsegment <> 'BUILDING' OR o_orderstatus <> 'F' THEN 'NOT_APPLICABLE' WHEN o_orderkey % 24 >= 8 AND o_orderkey % 24 < 18 THEN 'PASS' ELSE 'FAIL' END",
                 lambda: rules.gate_hours(F.col("c_mktsegment"), "BUILDING", F.col("o_orderstatus"), "F", F.date_trunc("day", "o_orderdate") + F.make_interval(hours=(F.col("o_orderkey") % 24).cast("int")), 8, 18)),
    "rule_008": ("CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN 'NOT_APPLICABLE' WHEN o_orderkey % 24 >= 20 OR o_orderkey % 24 < 6 THEN 'FAIL' ELSE 'PASS' END",
                 lambda: rules.no_overnight(F.col("c_mktsegment"), "HOUSEHOLD", F.date_trunc("day", "o_orderdate") + F.make_interval(hours=(F.col("o_orderkey") % 24).cast("int")))),
    "rule_009": ("CASE WHEN month(o_orderdate) IN (7, 8, 9) THEN 'FAIL' ELSE 'NOT_APPLICABLE' END", lambda: rules.seasonal_padding(rules.in_season(F.col("o_orderdate"), (7, 8, 9)), F.lit(36), 20)[0]),
    "rule_013": ("CASE WHEN o_custkey % 3 = 0 THEN 'INSUFFICIENT_DATA' WHEN NOT (o_orderkey % 24 >= 21 OR o_orderkey % 24 < 5) THEN 'NOT_APPLICABLE' WHEN o_custkey % 7 = 0 THEN 'INSUFFICIENT_DATA' WHEN 12 * (1998 - year(o_orderdate)) + 1 - month(o_orderdate) - CAST(1 < day(o_orderdate) AS INTEGER) >= 6 THEN 'PASS' ELSE 'FAIL' END",
                 lambda: rules.night_driver(F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")), F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderdate")), F.date_trunc("day", "o_orderdate") + F.make_interval(hours=(F.col("o_orderkey") % 24).cast("int")), F.lit("1998-01-01"))),
}
for key, (sql, build) in SIMPLE_RULES.items():

    @query(key, f"SELECT o_orderkey, {sql} AS verdict FROM orders JOIN customer ON o_custkey = c_custkey")
    def simple_rule(s, d, build=build):
        return t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", build().alias("verdict"))


