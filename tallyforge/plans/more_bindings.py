"""Further queries: sources, sinks, nested values, reports, ordering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import core as c
from tallyforge.operators import reports, resolve, rules
from tallyforge.sources import delimited, tickets

from tallyforge.operators.people import mask_people

from .bindings import FINGERPRINT, TOKENS, query, t


@query("src_02", "SELECT p_partkey AS key, CAST(2 AS BIGINT) AS row, 'say \"' || p_name || '\", ' || p_brand AS name, CAST(p_size AS VARCHAR) AS size FROM part")
def src_02(s, d):
    text = F.concat(F.lit('name,size\r\n"say ""'), F.col("p_name"), F.lit('"", '), F.col("p_brand"), F.lit('", '), F.col("p_size").cast("string"), F.lit("\r\n\r\n"))
    texts = t(s, d, "part").select(F.col("p_partkey").alias("key"), text.alias("value"))
    return delimited.records_of(texts, ["name", "size"]).select("key", F.col("_row").alias("row"), "name", "size")


@query("src_03", "SELECT p_partkey, [',', ';', chr(9), '|'][CAST(p_partkey % 4 AS INTEGER) + 1] AS delimiter FROM part")
def src_03(s, d):
    sep = F.element_at(F.array(*map(F.lit, delimited.DELIMITERS)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t(s, d, "part").select("p_partkey", delimited.sniff_column(F.concat_ws("x", F.lit("a"), sep, sep, F.lit("b"))).alias("delimiter"))


@query("src_06", "SELECT event_id AS key, ['json_array', 'json_object.rows', 'json_single_object', 'jsonl', 'csv', 'unknown'][CAST(event_id % 6 AS INTEGER) + 1] AS format, CAST([2, 1, 1, 2, 1, 0][CAST(event_id % 6 AS INTEGER) + 1] AS BIGINT) AS records FROM events")
def src_06(s, d):
    p, i = F.col("props"), F.col("event_id") % 6
    text = F.when(i == 0, F.concat(F.lit("["), p, F.lit(","), p, F.lit("]"))).when(i == 1, F.concat(F.lit('{"rows": ['), p, F.lit("]}"))).when(i == 2, p).when(i == 3, F.concat(p, F.lit("\n"), p, F.lit("\n{bad"))).when(i == 4, F.lit("a,b\n1,2\n")).otherwise("plain")
    got = tickets.containers(t(s, d, "events").select(F.col("event_id").alias("key"), F.lit("f").alias("name"), text.alias("value")))
    return got.select("key", "format", F.size(F.filter("records", lambda r: ~r["raw"].startswith('{"_bad_line"'))).cast("bigint").alias("records"))


@query("src_13", "WITH l AS (SELECT conv_id, turn, string_split(replace(text, chr(13), ''), chr(10)) AS x FROM conversations) SELECT conv_id, turn, CAST(unnest(range(1, len(x) + 1)) AS BIGINT) AS line_no, unnest(x) AS line FROM l")
def src_13(s, d):
    lines = t(s, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line"))
    return lines.select("conv_id", "turn", (F.col("pos") + 1).cast("bigint").alias("line_no"), F.regexp_replace("line", "\r", "").alias("line"))


@query("prj_06", "SELECT p_partkey AS key, p_name AS long, p_name AS bare, 'id,registration,vehicle_deep_x,vehicle_registration' AS names FROM part")
def prj_06(s, d):
    deep = F.struct(F.struct(F.lit(1).alias("y")).alias("x"))
    record = F.to_json(F.struct(F.struct(F.col("p_name").alias("registration"), deep.alias("deep")).alias("vehicle"), F.col("p_partkey").alias("id")))
    flat = t(s, d, "part").select(F.col("p_partkey").alias("key"), F.map_from_entries(tickets.flatten(record)).alias("f"))
    return flat.select("key", F.col("f.vehicle_registration").alias("long"), F.col("f.registration").alias("bare"), F.array_join(F.array_sort(F.map_keys("f")), ",").alias("names"))


@query("prj_12", "SELECT o_orderkey, n_name AS origin, r_name AS destination FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def prj_12(s, d):
    o = t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.select("o_orderkey", F.struct(F.col("n_name").alias("origin"), F.col("r_name").alias("destination")).alias("route")).select("o_orderkey", "route.origin", "route.destination")


@query("join_13", "SELECT n_nationkey, array_to_string(list_sort(list(r_name)), ',') AS regions FROM nation JOIN region ON r_regionkey IN (n_regionkey, (n_regionkey + 1) % 5) GROUP BY 1")
def join_13(s, d):
    ids = F.array("n_regionkey", ((F.col("n_regionkey") + 1) % 5).cast("int"))
    x = t(s, d, "nation").select("n_nationkey", F.explode_outer(ids).alias("r_regionkey")).join(t(s, d, "region"), "r_regionkey", "left")
    return x.groupBy("n_nationkey").agg(F.array_join(F.array_sort(F.collect_list("r_name")), ",").alias("regions"))


@query("join_15", f"""WITH r AS (SELECT conv_id * 1000 + turn AS id, role, list_sort({TOKENS.format('text')}) AS w FROM conversations), k AS (SELECT min(id) AS id, role, w FROM r WHERE len(w) > 0 GROUP BY role, w),
    p AS (SELECT a.id AS id_a, b.id AS id_b, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS n, len(b.w) AS m FROM k a JOIN k b ON a.role = b.role AND a.id < b.id)
    SELECT id_a, id_b, round(CAST(i AS DOUBLE) / (n + m - i), 6) AS similarity FROM p WHERE CAST(i AS DOUBLE) / (n + m - i) >= 0.9""")
def join_15(s, d):
    from tallyforge.operators.dedup import near_pairs

    rows = t(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", c.subject_tokens("text").alias("tokens"))
    pairs, _ = near_pairs(rows, "role", "id", "tokens", 0.9)
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query("agg_04", "SELECT l_suppkey, strftime(max(l_shipdate) FILTER (l_returnflag = 'A'), '%Y-%m-%d') AS last_brake FROM lineitem GROUP BY 1")
def agg_04(s, d):
    return t(s, d, "lineitem").groupBy("l_suppkey").agg(F.date_format(F.max(F.when(F.col("l_returnflag") == "A", F.col("l_shipdate"))), "yyyy-MM-dd").alias("last_brake"))


@query("agg_07", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders")
def agg_07(s, d):
    return t(s, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("bigint").alias("place"))


@query("agg_13", "SELECT count(*)::BIGINT AS total, count(*) FILTER (event_type = 'error')::BIGINT AS errors, count(*) FILTER (value IS NULL)::BIGINT AS missing FROM events")
def agg_13(s, d):
    return reports.kpis(t(s, d, "events"), errors=F.col("event_type") == "error", missing=F.col("value").isNull())


@query("agg_20", "SELECT lang, count(*)::BIGINT AS n, count(*) = count(DISTINCT text) AS unique_texts FROM documents GROUP BY 1")
def agg_20(s, d):
    return t(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("text").alias("k")).select("lang", "n", (F.col("n") == F.col("k")).alias("unique_texts"))


@query("win_07", f"SELECT {FINGERPRINT} AS fp, doc_id, row_number() OVER (PARTITION BY {FINGERPRINT} ORDER BY (source = 'src0') DESC, doc_id) AS place FROM documents")
def win_07(s, d):
    docs = t(s, d, "documents").select(c.fingerprint("text").alias("fp"), "doc_id", "source")
    return docs.select("fp", "doc_id", F.row_number().over(Window.partitionBy("fp").orderBy((F.col("source") == "src0").desc(), "doc_id")).cast("bigint").alias("place"))


@query("srt_01")
def srt_01(s, d):
    """Locale-aware order (ICU): DuckDB's collations differ; tests hold it against literals."""
    return t(s, d, "nation").select("n_nationkey", "n_name").orderBy(F.expr("collate(n_name, 'UNICODE')"), "n_nationkey").limit(25)


@query("srt_02", "SELECT s_name, row_number() OVER (ORDER BY s_name) AS place FROM supplier")
def srt_02(s, d):
    """Code-unit order over a whole table: ranges in order, then places counted on from the ranges before."""
    from tallyforge.operators.resolve import global_rank

    return global_rank(t(s, d, "supplier").select("s_name"), "s_name", "place")


@query("srt_04", "SELECT o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1")
def srt_04(s, d):
    return t(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_orderpriority")


@query("set_05", "SELECT p_partkey, len(list_intersect(list_distinct(string_split(p_name, ' ')), list_distinct(string_split(p_type, ' '))))::BIGINT AS both FROM part")
def set_05(s, d):
    a, b = (F.array_distinct(F.split(x, " ")) for x in ("p_name", "p_type"))
    return t(s, d, "part").select("p_partkey", F.size(F.array_intersect(a, b)).cast("bigint").alias("both"))


@query("str_01", "SELECT p_partkey, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, upper(trim(p_brand)) AS brand, replace(p_type, ' ', '_') AS type, substr(p_name, 1, 3) AS head FROM part")
def str_01(s, d):
    return t(s, d, "part").select("p_partkey", F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"), F.upper(F.trim("p_brand")).alias("brand"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("type"), F.substring("p_name", 1, 3).alias("head"))


@query("pii_02", "WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]{2,}')) AS word FROM conversations) SELECT substr(word, 1, 1) || repeat('*', length(word) - 1) AS preview, count(*)::BIGINT AS n FROM w GROUP BY 1")
def pii_02(s, d):
    words = t(s, d, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{2,}"), F.lit(0))).alias("word"))
    return words.groupBy(c.preview("word").alias("preview")).agg(F.count("*").alias("n"))


@query("str_11_register", """WITH g AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]{2,}')) AS w FROM benchmark)), n AS (SELECT w FROM g UNION SELECT 'no such person' UNION SELECT 'al'),
    d AS (SELECT doc_id, text, unnest(CASE WHEN text = '' THEN [''] ELSE regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+') END) AS x, generate_subscripts(CASE WHEN text = '' THEN [''] ELSE regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+') END, 1) AS i FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, sha256(string_agg(CASE WHEN w IS NOT NULL AND length(w) > 2 THEN '[REDACTED:PERSON]' ELSE x END, '' ORDER BY i)) AS masked, bool_or(w IS NOT NULL AND length(w) > 2) AS person_hit FROM d LEFT JOIN n ON lower(x) = w GROUP BY doc_id, text
    UNION ALL SELECT doc_id, NULL, false FROM documents WHERE text IS NULL""")
def str_11_register(s, d):
    """Every document, with a register of the capitalised words of the benchmark."""
    words = t(s, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{2,}"), F.lit(0))).alias("name"))
    names = words.unionByName(s.createDataFrame([("No such person",), ("Al",)], "name string"))
    return mask_people(t(s, d, "documents").select("doc_id", "text"), "text", names).select("doc_id", F.sha2("text", 256).alias("masked"), "person_hit")


@query("win_02_state", "SELECT user_id, count(*)::BIGINT AS n FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE value < p GROUP BY 1")
def win_02_state(s, d):
    return resolve.regressions(t(s, d, "events"), "user_id", ["ts", "event_id"], "value").groupBy("user_id").agg(F.count("*").alias("n"))


@query("rule_011_borderline", "SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-01') - 180 BETWEEN 15 AND 30 AS borderline FROM orders")
def rule_011_borderline(s, d):
    return t(s, d, "orders").select("o_orderkey", rules.overdue_service(F.col("o_orderdate"), F.lit("1998-08-01"))[1].alias("borderline"))
