"""Queries over the readers, writers, masks and the context, each through the library's functions, with SQL on the driver's tables."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from tallyforge.functions import core as c
from tallyforge.operators import context, emit, reports
from tallyforge.operators.runlog import RunLog
from tallyforge.scratch import file_system, fresh, put_text
from tallyforge.sources import config, delimited, documents, names, registers, tickets, xlsx

from .bindings import NOTE, PLATE, notes, plates, query, t
from .decision import Rulebook, build_context

SECRET = b"test key"
IPAD, OPAD = (bytes(b ^ p for b in SECRET.ljust(64, b"\0")).hex() for p in (0x36, 0x5C))


def hmac_sql(kind: str, x: str) -> str:
    """The keyed pseudonym in SQL."""
    return f"'{kind}-' || upper(substr(sha256(from_hex('{OPAD}') || from_hex(sha256(from_hex('{IPAD}') || encode('{kind}:' || upper({x}))))), 1, 10))"


# ---- delimited text, archives, spreadsheets


@query("src_01", """SELECT p_partkey AS key, CAST(unnest([1, 1, 2, 2]) AS BIGINT) AS row, CAST(unnest([1, 2, 1, 2]) AS BIGINT) AS col,
    unnest([p_name, 'q "' || p_brand || '", r', 'two' || chr(10) || 'lines', CAST(p_size AS VARCHAR)]) AS cell FROM part""")
def src_01(s, d):
    text = F.concat("p_name", F.lit(',"q ""'), "p_brand", F.lit('"", r"\r\n"two\nlines",'), F.col("p_size").cast("string"))
    rows = t(s, d, "part").select(F.col("p_partkey").alias("key"), F.posexplode(delimited.rows_of(text)).alias("row", "cells"))
    cells = rows.select("key", (F.col("row") + 1).cast("bigint").alias("row"), F.posexplode("cells").alias("col", "cell"))
    return cells.withColumn("col", (F.col("col") + 1).cast("bigint"))


def _zipped(files: dict[str, tuple[str, int]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, (text, how) in files.items():
            z.writestr(name, text, how)
    return out.getvalue()


def _archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for key, name in zip(b["n_nationkey"], b["n_name"], strict=True):
            content = _zipped({f"a/{name}.txt": (name, zipfile.ZIP_STORED), "b.txt": (name * 50, zipfile.ZIP_DEFLATED)})
            rows += [(key, n, len(x), hashlib.sha256(x).hexdigest()) for n, x in xlsx.read_zip(content).items()]
        yield pd.DataFrame(rows, columns=["key", "name", "size", "digest"])


@query("src_04", """SELECT n_nationkey AS key, unnest(['a/' || n_name || '.txt', 'b.txt']) AS name, CAST(unnest([length(n_name), 50 * length(n_name)]) AS BIGINT) AS size, unnest([sha256(n_name), sha256(repeat(n_name, 50))]) AS digest FROM nation""")
def src_04(s, d):
    return t(s, d, "nation").select("n_nationkey", "n_name").mapInPandas(_archives, "key int, name string, size bigint, digest string")


def _workbook(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared = "".join(f"<si><r><t>{n[:2]}</t></r><r><t>{n[2:]}</t></r></si>" for n in rows["n_name"])
    body = "".join(f'<row r="{i + 3}"><c r="A{i + 3}" t="s"><v>{i}</v></c><c r="C{i + 3}"><v>{k}</v></c></row>' for i, k in enumerate(rows["n_nationkey"]))
    head = '<row r="1"><c r="A1" t="inlineStr"><is><t>name &amp; all</t></is></c><c r="C1" t="str"><v>key</v></c></row><row r="2"/>'
    files = {"xl/sharedStrings.xml": f"<sst {ns}>{shared}</sst>", "xl/worksheets/sheet10.xml": f"<worksheet {ns}/>", "xl/worksheets/sheet2.xml": f"<worksheet {ns}><sheetData>{head}{body}</sheetData></worksheet>"}
    return pd.DataFrame({"path": [f"x/r{key[0]}.xlsx"], "content": [_zipped({n: (x, zipfile.ZIP_DEFLATED) for n, x in files.items()})]})


@query("src_05", "SELECT 'r' || n_regionkey || '.xlsx' AS file, 2 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS row, n_name AS name, CAST(n_nationkey AS VARCHAR) AS key FROM nation")
def src_05(s, d):
    files = t(s, d, "nation").select("n_regionkey", "n_nationkey", "n_name").groupBy("n_regionkey").applyInPandas(lambda k, x: _workbook(k, x.sort_values("n_nationkey")), "path string, content binary")
    return xlsx.sheets_of(files, ["name & all", "key"]).select(F.col("_source").alias("file"), F.col("_row").alias("row"), F.col("name & all").alias("name"), "key")


@query("src_07", """SELECT event_id AS key, 'E-' || event_id AS ticket_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, 'tr ' || user_id AS vehicle, CAST(event_id % 90 AS DOUBLE) AS km,
    CASE event_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'ODD' END AS severity, 'extra,vehicle_more' AS unmapped, 'json_object.queue' AS format FROM events""")
def src_07(s, d):
    k = F.col("event_id").cast("string")
    record = F.concat(F.lit('{"Ticket-Ref": "E-'), k, F.lit('", "raised_on": "'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit('", "vehicle": {"registration": "tr '), F.col("user_id").cast("string"), F.lit('", "more": 1}, "distance": "'), (F.col("event_id") % 90).cast("string"), F.lit(' km", "priority": "'), F.element_at(F.array(*map(F.lit, ("P1", "p2", "odd"))), (F.col("event_id") % 3 + 1).cast("int")), F.lit('", "extra": 1}'))
    texts = t(s, d, "events").select(k.alias("name"), F.concat(F.lit('{"queue": ['), record, F.lit("]}")).alias("value"))
    return tickets.tickets_of(texts).select(F.col("file").cast("bigint").alias("key"), "ticket_id", "created_at", "vehicle", F.col("km_from_origin_hub").alias("km"), "severity", F.array_join(F.filter("unmapped", lambda x: x != "more"), ",").alias("unmapped"), "format")


# ---- registers


def fleet_rows(s, d):
    k = F.col("s_suppkey")
    text = {"registration_number": F.when(k % 7 != 0, F.lower("plate")).otherwise(""), "vehicle_id": F.when(k % 4 != 0, F.concat(F.lit("v"), k)).otherwise(""), "model": F.lit("m"), "year": F.concat(F.lit("20"), F.lpad((k % 25).cast("string"), 2, "0")), "bs_stage": F.when(k % 2 == 0, "BS6").otherwise(""), "engine_heater": F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "no").otherwise(""), "home_hub": F.concat(F.lit("hub"), F.col("s_nationkey")), "capacity_tonnes": F.when(k % 5 != 0, F.col("s_acctbal").cast("string")).otherwise("heavy"), "status": F.lit("Active")}
    return plates(s, d).select(*(v.alias(n) for n, v in text.items()), k.alias("_row"), F.lit("fleet.csv").alias("_source"))


KEY_SQL = f"regexp_replace(upper({PLATE}), '[^A-Z0-9]', '', 'g')"


@query("src_08", f"""SELECT {KEY_SQL} AS reg_key, CASE WHEN s_suppkey % 4 <> 0 THEN 'v' || s_suppkey END AS vehicle_id, CAST(2000 + s_suppkey % 25 AS BIGINT) AS year, CASE WHEN s_suppkey % 2 = 0 THEN 'BS6' END AS bs_stage,
    CASE s_suppkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS engine_heater, 'hub' || s_nationkey AS home_hub, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS capacity_tonnes, 'fleet.csv#row' || s_suppkey AS citation FROM supplier WHERE s_suppkey % 7 <> 0""")
def src_08(s, d):
    kept, _ = registers.fleet(fleet_rows(s, d))
    return kept.select("reg_key", "vehicle_id", F.col("year").cast("bigint").alias("year"), "bs_stage", F.col("engine_heater").cast("string").alias("engine_heater"), "home_hub", "capacity_tonnes", "citation")


@query("src_08_alerts", "SELECT 'FLEET_ROW_NO_REGISTRATION' AS code, 'fleet.csv' AS file, s_suppkey AS row FROM supplier WHERE s_suppkey % 7 = 0")
def src_08_alerts(s, d):
    return registers.fleet(fleet_rows(s, d))[1]


def driver_rows(s, d):
    k = F.col("c_custkey")
    return t(s, d, "customer").select(F.when(k % 11 != 0, F.concat(F.lit("D"), k)).alias("driver_id"), F.concat(F.lit(" "), F.col("c_name")).alias("name"), F.when(k % 5 != 0, F.date_format(F.date_add(F.lit("2019-01-01"), (k % 1000).cast("int")), "yyyy-MM-dd")).otherwise("").alias("joining_date"), F.lit("98").alias("phone"), F.concat(F.lit("hub"), F.col("c_nationkey")).alias("home_hub"), k.alias("_row"), F.lit("drivers.csv").alias("_source"))


@query("src_09", f"""SELECT 'D' || c_custkey AS driver_id, {hmac_sql('PERSON', 'c_name')} AS person_ref, CASE WHEN c_custkey % 5 <> 0 THEN strftime(DATE '2019-01-01' + CAST(c_custkey % 1000 AS INTEGER), '%Y-%m-%d') END AS joining_date,
    'hub' || c_nationkey AS home_hub, 'drivers.csv#row' || c_custkey AS citation FROM customer WHERE c_custkey % 11 <> 0""")
def src_09(s, d):
    return registers.drivers(driver_rows(s, d), SECRET)[0].withColumn("joining_date", F.col("joining_date").cast("string"))


def workshop_rows(s, d):
    return notes(s, d).select(F.concat(F.lit("ab-"), F.col("l_suppkey")).alias("vehicle"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_quantity").cast("string").alias("odometer_km"), F.concat(F.lit("mech "), F.col("l_linenumber")).alias("mechanic"), F.concat("note", F.lit(", ask shop@depot.example")).alias("notes"), F.col("l_linenumber").alias("_row"), F.concat(F.lit("o"), F.col("l_orderkey")).alias("_source"))


@query("src_10", f"""WITH n AS (SELECT *, {NOTE} AS note FROM lineitem) SELECT 'AB' || l_suppkey AS reg_key, strftime(l_shipdate, '%Y-%m-%d') AS date, l_quantity AS odometer_km, {hmac_sql('MECHANIC', "'mech ' || l_linenumber")} AS mechanic_ref,
    note || ', ask [REDACTED:EMAIL]' AS notes, l_returnflag = 'R' AS jugaad, l_returnflag = 'A' AS brake_work, l_returnflag = 'A' AS permanent_repair, l_returnflag = 'A' AS road_tested, false AS under_warranty, 'o' || l_orderkey || '#row' || l_linenumber AS citation FROM n""")
def src_10(s, d):
    return registers.maintenance(workshop_rows(s, d), SECRET)[0].withColumn("date", F.col("date").cast("string"))


@query("src_11", """SELECT CAST(o_orderkey AS VARCHAR) AS trip_id, CASE WHEN o_custkey % 3 <> 0 THEN 'T' || o_custkey END AS reg_key, o_orderstatus AS status, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS osrm_time_min,
    'trips.csv#row' || o_orderkey AS citation FROM orders WHERE o_orderkey % 13 <> 0""")
def src_11(s, d):
    k = F.col("o_orderkey")
    none = [F.lit("").alias(x) for x in ("driver_id", "client", "route_type", "dispatch_time", "delivery_time", "origin_name", "dest_name", "actual_time_min", "osrm_distance_km")]
    rows = t(s, d, "orders").select(F.when(k % 13 != 0, k.cast("string")).otherwise("").alias("trip_id"), F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("t-"), F.col("o_custkey"))).otherwise("-").alias("vehicle_reg"), F.col("o_orderstatus").alias("status"), F.when(k % 2 == 0, F.col("o_totalprice").cast("string")).otherwise("?").alias("osrm_time_min"), *none, k.alias("_row"), F.lit("trips.csv").alias("_source"))
    return registers.trips(rows)[0].select("trip_id", "reg_key", "status", "osrm_time_min", "citation")


# ---- documents, configuration, logs


@query("src_12", """SELECT conv_id || '-' || turn || '.txt' AS file, 'Re ' || role AS subject, '2 Mar 2026|3 Mar 2026' AS dates, 'Hello' || chr(10) || 'turn ' || turn || chr(10) || text AS body,
    substr(sha256(lower(trim(regexp_replace('Hello' || chr(10) || 'turn ' || turn || chr(10) || text, '[ \\t\\r\\n]+', ' ', 'g')))), 1, 16) AS claim_key FROM conversations""")
def src_12(s, d):
    head = F.concat(F.lit("From: a@b.example\r\nDate: 2 Mar 2026\nSubject:  Re "), F.col("role"), F.lit("\n-----\nHello\nDate:  3 Mar 2026\nturn "), F.col("turn"), F.lit("\n"), F.col("text"))
    mails = documents.mails_of(t(s, d, "conversations").select(F.concat(F.col("conv_id"), F.lit("-"), F.col("turn"), F.lit(".txt")).alias("file"), head.alias("value")))
    return mails.select("file", "subject", F.array_join("dates", "|").alias("dates"), "body", "claim_key")


@query("src_13_roles", """SELECT conv_id, turn, CAST(unnest([1, 2]) AS BIGINT) AS line_no, unnest(['DISPATCHER', NULL]) AS speaker, unnest(['Dispatcher: mail [REDACTED:EMAIL]', role]) AS text, unnest(['EMAIL', '']) AS redacted FROM conversations""")
def src_13_roles(s, d):
    rows = t(s, d, "conversations").select("conv_id", "turn", F.concat(F.lit("Dispatcher: mail ops@depot.example\r\n"), F.col("role"), F.lit("\n  ")).alias("value"))
    return documents.transcript_of(rows, key=("conv_id", "turn")).select("conv_id", "turn", F.col("line_no").cast("bigint").alias("line_no"), "speaker", "text", F.array_join("redacted", ",").alias("redacted"))


@query("src_14", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def src_14(s, d):
    """Written as JSON lines and read with a schema; a path that is not there is an empty table."""
    path = fresh(s, "events")
    t(s, d, "events").select(F.to_json(F.struct("event_id", F.from_json("props", "k bigint")["k"].alias("k"))).alias("value")).write.text(path)
    return documents.read_json_lines(s, path, "event_id bigint, k bigint").unionByName(documents.read_json_lines(s, f"{path}-none", "event_id bigint, k bigint"))


@query("src_15", "SELECT * FROM (VALUES ('Acme', '48', 'desk@acme.example'), ('Internal', NULL, NULL)) AS v(client, sla_hours, mailbox)")
def src_15(s, d):
    path = fresh(s, "rulebook")
    put_text(s, f"{path}/rulebook.json", '{"limit_km": 40, "clients": {"Acme": {"sla_hours": 48, "mailbox": "desk@acme.example"}, "Internal": {}}}')
    book = Rulebook(**config.load_config(s, f"{path}/rulebook.json"))
    return s.createDataFrame([(k, v.get("sla_hours"), v.get("mailbox")) for k, v in book.clients.items()], "client string, sla_hours int, mailbox string").withColumn("sla_hours", F.col("sla_hours").cast("string"))


@query("src_17", """SELECT 'run_004.log' AS file, CASE WHEN event_type = 'error' THEN 'error' ELSE 'alert' END AS kind, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ALERT SLOW' END AS event,
    '{"level":"' || CASE WHEN event_type = 'error' THEN 'error' ELSE 'warn' END || '","event":"' || CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ALERT SLOW' END || '","id":' || event_id || '}' AS line
    FROM events WHERE event_id % 5 = 4 AND event_type IN ('error', 'click')""")
def src_17(s, d):
    kind = F.col("event_type")
    level = F.when(kind == "error", "error").when(kind == "click", "warn").otherwise("info")
    event = F.when(kind == "error", "failed").when(kind == "click", "ALERT SLOW").otherwise("done")
    lines = t(s, d, "events").select(F.concat(F.lit("run_00"), F.col("event_id") % 5, F.lit(".log")).alias("file"), F.to_json(F.struct(level.alias("level"), event.alias("event"), F.col("event_id").alias("id"))).alias("value"))
    other = s.createDataFrame([("zzz.log", '{"level":"error","event":"x"}')], "file string, value string")
    return reports.last_run(lines.unionByName(other))


# ---- writers


@query("snk_01", """SELECT n_nationkey, '{"a":{"b":null,"c":"' || n_name || '"},"list":[{"x":1,"y":2}],"map":{"k1":' || n_nationkey || ',"k2":' || n_regionkey || '}}' AS line FROM nation""")
def snk_01(s, d):
    nested = [F.col("n_nationkey"), F.create_map(F.lit("k2"), F.col("n_regionkey"), F.lit("k1"), F.col("n_nationkey")).alias("map"), F.array(F.struct(F.lit(2).alias("y"), F.lit(1).alias("x"))).alias("list"), F.struct(F.col("n_name").alias("c"), F.lit(None).cast("string").alias("b")).alias("a")]
    df = t(s, d, "nation").select(*nested)
    return df.select("n_nationkey", emit.sorted_json(df.drop("n_nationkey")).alias("line"))


@query("snk_02", """SELECT '{"key":' || n_nationkey || ',"name":"' || n_name || '"}' AS line FROM nation""")
def snk_02(s, d):
    """Written twice; the second run replaces the first."""
    path = fresh(s, "lines")
    df = t(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"))
    emit.write_jsonl(df.limit(3), "key", path)
    emit.write_jsonl(df, "key", path)
    return s.read.text(path).withColumnRenamed("value", "line")


@query("snk_03", """SELECT '{' || chr(10) || '  "a": null,' || chr(10) || '  "regions": [' || chr(10) || string_agg('    "' || r_name || '"', ',' || chr(10) ORDER BY r_name) || chr(10) || '  ]' || chr(10) || '}' || chr(10) AS text FROM region""")
def snk_03(s, d):
    path = fresh(s, "pretty")
    emit.write_json(s, f"{path}/x.json", {"regions": [r.r_name for r in t(s, d, "region").orderBy("r_name").collect()], "a": None})  # five rows
    return s.read.text(f"{path}/x.json", wholetext=True).withColumnRenamed("value", "text")


@query("snk_05", "SELECT 'hubs' AS source, count(*)::BIGINT AS n_rows, true AS same FROM nation UNION ALL SELECT 'vehicles', count(*)::BIGINT, true FROM supplier")
def snk_05(s, d):
    """Written as a snapshot; the hash of what is read back, in another order and other partitions, is that of what was written."""
    hubs, vehicles = t(s, d, "nation").select("n_nationkey", "n_name"), t(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    path = fresh(s, "context")
    told = context.save_context({"hubs": (hubs, "n_nationkey"), "vehicles": (vehicles, "s_suppkey")}, path)
    back = {n: s.read.schema(df.schema).json(f"{path}/{n}").repartition(3) for n, df in (("hubs", hubs), ("vehicles", vehicles))}
    again = context.stats(back).select("source", F.col("digest").alias("again"))
    return told.join(again, "source").select("source", "n_rows", (F.col("digest") == F.col("again")).alias("same"))


@query("agg_15", "SELECT source, n_rows, sha256(n_rows || '|' || a || '|' || b) AS digest FROM (SELECT 'region' AS source, count(*) AS n_rows, sum(CAST('0x' || substr(h, 1, 8) AS BIGINT)) AS a, sum(CAST('0x' || substr(h, 9, 8) AS BIGINT)) AS b FROM (SELECT sha256('{\"k\":' || r_regionkey || ',\"n\":\"' || r_name || '\"}') AS h FROM region) UNION ALL SELECT 'orders', count(*), sum(CAST('0x' || substr(h, 1, 8) AS BIGINT)), sum(CAST('0x' || substr(h, 9, 8) AS BIGINT)) FROM (SELECT sha256('{\"k\":' || o_orderkey || ',\"n\":\"' || o_orderstatus || '\"}') AS h FROM orders))")
def agg_15(s, d):
    return context.stats({"region": t(s, d, "region").select(F.col("r_name").alias("n"), F.col("r_regionkey").alias("k")), "orders": t(s, d, "orders").select(F.col("o_orderstatus").alias("n"), F.col("o_orderkey").alias("k"))})


@query("snk_07", """SELECT 'run_1.log' AS file, CAST(row_number() OVER (ORDER BY n_nationkey) AS BIGINT) AS line_no, '{"level": "' || CASE WHEN n_nationkey % 2 = 0 THEN 'warn' ELSE 'error' END || '", "event": "' || CASE WHEN n_nationkey % 2 = 0 THEN 'ALERT ' || n_name ELSE n_name END || '", "to": ["[REDACTED:EMAIL]"]}' AS line
    FROM nation""")
def snk_07(s, d):
    """Debug lines stay out, details are masked, alerts are warnings; written and read back."""
    log, path = RunLog("info"), fresh(s, "logs")
    for r in t(s, d, "nation").orderBy("n_nationkey").collect():  # 25 rows
        log.log("debug", "seen", n=r.n_nationkey)
        (log.alert if r.n_nationkey % 2 == 0 else lambda e, **x: log.log("error", e, **x))(r.n_name, to=["ops@depot.example"])
    log.write(s, f"{path}/run_1.log")
    lines = s.read.text(f"{path}/run_1.log", wholetext=True).select(F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\n")).alias("at", "line"))
    return lines.select(F.lit("run_1.log").alias("file"), (F.col("at") + 1).cast("bigint").alias("line_no"), "line")


# ---- masks, names, small functions

NOT_WORD = "[^A-Za-z0-9_]"
EMAIL_RE = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
#: (kind, pattern between a group for what stands before and one for what follows): the detectors without look-around.
PLAIN_RE = (
    ("EMAIL", f"()({EMAIL_RE})($|{NOT_WORD})"), ("AADHAAR", f"(^|{NOT_WORD})([0-9]{{4}}[ -][0-9]{{4}}[ -][0-9]{{4}})($|{NOT_WORD})"),
    ("DL_NUMBER", f"(?i)(^|{NOT_WORD})([A-Z]{{2}}[ -]?[0-9]{{2}}[ -][0-9]{{11}})($|{NOT_WORD})"), ("PHONE", f"()(\\+?91[ -]?(?:[0-9]{{5}}[ -]?[0-9]{{5}}|[0-9]{{10}}))($|{NOT_WORD})"), ("PHONE", "(^|[^0-9.])([6-9][0-9]{9})($|[^0-9.])"),
)


def masked_sql(x: str) -> str:
    for kind, pattern in PLAIN_RE:
        x = f"regexp_replace({x}, '{pattern}', '\\1[REDACTED:{kind}]\\3', 'g')"
    return x


def kinds_sql(x: str) -> str:
    each = {k: " OR ".join(f"regexp_matches({x}, '{p}')" for kind, p in PLAIN_RE if kind == k) for k in ("AADHAAR", "DL_NUMBER", "EMAIL", "PHONE")}
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {test} THEN '{k}' END" for k, test in each.items()) + ")"


#: Documents with one more line that every detector but one has something to find in, by id.
LEAKY_SQL = "text || chr(10) || CASE doc_id % 6 WHEN 0 THEN 'id 1234 5678 9012.' WHEN 1 THEN 'HR16 20128663605' WHEN 2 THEN 'call +91 98765 43210' WHEN 3 THEN '9876543210 now' WHEN 4 THEN 'ops@depot.example' ELSE 'none' END"


def leaky(s, d):
    more = F.element_at(F.array(*map(F.lit, ("id 1234 5678 9012.", "HR16 20128663605", "call +91 98765 43210", "9876543210 now", "ops@depot.example", "none"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return t(s, d, "documents").select("doc_id", F.concat("text", F.lit("\n"), more).alias("text"))


@query("str_09", f"WITH x AS (SELECT doc_id, {LEAKY_SQL} AS text FROM documents) SELECT doc_id, {masked_sql('text')} AS masked, {kinds_sql('text')} AS hits FROM x")
def str_09(s, d):
    r = leaky(s, d).select("doc_id", c.redact("text").alias("r"))
    return r.select("doc_id", F.col("r.text").alias("masked"), F.array_join("r.hits", ",").alias("hits"))


@query("flt_12", f"WITH x AS (SELECT doc_id, replace({LEAKY_SQL}, 'ops@depot.example', ' ') AS text FROM documents) SELECT doc_id, {kinds_sql('text')} AS kinds FROM x")
def flt_12(s, d):
    return leaky(s, d).select("doc_id", F.array_join(c.violations("text", allow=("ops@depot.example",)), ",").alias("kinds"))


@query("emt_05", f"WITH x AS (SELECT doc_id, regexp_replace({LEAKY_SQL}, '[\\n\\r\\t]', ' ', 'g') AS text FROM documents), y AS (SELECT doc_id, {kinds_sql('text')} AS kinds FROM x) SELECT * FROM y WHERE kinds <> ''")
def emt_05(s, d):
    return emit.gate_report(leaky(s, d), "doc_id").select("doc_id", F.array_join("kinds", ",").alias("kinds"))


@query("str_10", f"SELECT c_custkey, {hmac_sql('PERSON', 'c_name')} AS pseudonym FROM customer")
def str_10(s, d):
    return t(s, d, "customer").select("c_custkey", c.pseudonym("c_name", "PERSON", SECRET).alias("pseudonym"))


def interviews(s, d):
    cased = F.concat(F.lit("N"), F.char(97 + F.col("n_nationkey") % 26), F.lit("ra"))
    return t(s, d, "nation").select("n_nationkey", F.concat(F.lit("Depot interview: Mira "), cased, F.lit(", mechanic\nINTERVIEWER: hello\n"), F.upper(cased), F.lit(" BO: yes\n\n"), cased, F.lit("\n-----\ntext\nMira\nTeam\n")).alias("value"))


CASED = "'N' || chr(97 + n_nationkey % 26) || 'ra'"


@query("str_13", f"""WITH n AS (SELECT {CASED} AS x FROM nation), h AS (SELECT 'Mira ' || x AS name FROM n UNION SELECT 'Mira' UNION SELECT x || ' bo' FROM n UNION SELECT x FROM n)
    SELECT 'transcript' AS place, name FROM h UNION ALL SELECT DISTINCT 'signature', x FROM n""")
def str_13(s, d):
    rows = interviews(s, d)
    return names.of_transcripts(rows).select(F.lit("transcript").alias("place"), "name").unionByName(names.of_signatures(rows, ["n_nationkey"]).select(F.lit("signature").alias("place"), "name"))


@query("pii_01", f"""WITH n AS (SELECT {CASED} AS x FROM nation) SELECT 'Mira ' || x AS name FROM n UNION SELECT 'Mira' UNION SELECT x || ' bo' FROM n UNION SELECT x FROM n
    UNION SELECT s_name FROM supplier UNION SELECT c_name FROM customer""")
def pii_01(s, d):
    rows = interviews(s, d)
    return names.collect_names([names.of_column(t(s, d, "supplier"), "s_name"), names.of_column(t(s, d, "customer"), "c_name"), names.of_transcripts(rows), names.of_signatures(rows, ["n_nationkey"]), s.createDataFrame([("Team",), ("Al",)], "name string")])


@query("str_14", "SELECT n_nationkey, '{\"a\":[\"' || n_name || ' [REDACTED:EMAIL]\",null],\"m\":{\"x@y.example\":{\"n\":' || n_nationkey || ',\"t\":\"[REDACTED:PHONE]\"}}}' AS json FROM nation")
def str_14(s, d):
    nested = F.struct(F.array(F.concat("n_name", F.lit(" a@b.example")), F.lit(None)).alias("a"), F.create_map(F.lit("x@y.example"), F.struct(F.col("n_nationkey").alias("n"), F.lit("9876543210").alias("t"))).alias("m")).alias("v")
    df = t(s, d, "nation").select("n_nationkey", nested)
    return df.select("n_nationkey", F.to_json(c.scrub_deep(F.col("v"), df.schema["v"].dataType)).alias("json"))


@query("str_15", "SELECT p_partkey, '&lt;b title=&quot;' || p_brand || '&quot;&gt;' || p_name || ' &amp; it&#39;s&lt;/b&gt;' AS html FROM part")
def str_15(s, d):
    return t(s, d, "part").select("p_partkey", c.html_escape(F.concat(F.lit('<b title="'), F.col("p_brand"), F.lit('">'), F.col("p_name"), F.lit(" & it's</b>"))).alias("html"))


@query("str_16", "SELECT p_partkey, CAST((p_partkey % 26 + 1) * 26 + p_partkey % 7 AS BIGINT) AS col, '<' || p_name || '> & \"q\" ''a'' &lt;' AS text FROM part")
def str_16(s, d):
    k = F.col("p_partkey")
    ref = F.concat(F.char(65 + k % 26), F.char(97 + k % 7), k)
    return t(s, d, "part").select("p_partkey", c.column_index(ref).cast("bigint").alias("col"), c.xml_unescape(F.concat(F.lit("&lt;"), F.col("p_name"), F.lit("&gt; &amp; &quot;q&quot; &apos;a&apos; &amp;lt;"))).alias("text"))


@query("dat_03", """SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') AS iso, event_id % 4 <> 3 AS ok, ['epoch_s', 'epoch_ms', 'iso', 'dd/mm/yyyy'][CAST(event_id % 4 AS INTEGER) + 1] AS form FROM events WHERE event_id % 4 <> 3
    UNION ALL SELECT event_id, strftime(ts, '%Y-13-%dT%H:%M:00'), false, 'dd/mm/yyyy' FROM events WHERE event_id % 4 = 3""")
def dat_03(s, d):
    i, sec = F.col("event_id") % 4, F.unix_timestamp("ts")
    raw = F.when(i == 0, sec.cast("string")).when(i == 1, F.concat(sec, F.lit("000"))).when(i == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+05:30'")).otherwise(F.date_format("ts", "dd/'13'/yyyy HH:mm"))
    return t(s, d, "events").select("event_id", c.timestamp_of(raw).alias("x")).select("event_id", "x.iso", "x.ok", "x.form")


# ---- context


@query("ctx_01", f"""WITH f AS (SELECT {KEY_SQL} AS k, * FROM supplier WHERE s_suppkey % 7 <> 0), m AS (SELECT k, arg_min(CASE WHEN s_suppkey % 4 <> 0 THEN 'v' || s_suppkey END, (CAST(s_suppkey % 4 = 0 AS INTEGER), 'fleet.csv#row' || s_suppkey)) FILTER (s_suppkey % 4 <> 0) AS vehicle_id, count(*) AS source_rows FROM f GROUP BY 1),
    w AS (SELECT 'AP' || lpad(CAST(l_suppkey % 100 AS VARCHAR), 2, '0') || 'Q' || lpad(CAST(l_suppkey % 10000 AS VARCHAR), 4, '0') AS k, * FROM lineitem), h AS (SELECT k, count(*) AS n_events, strftime(max(l_shipdate), '%Y-%m-%d') AS last_visit, arg_max(l_returnflag, (l_shipdate, 'o' || l_orderkey || '#row' || l_linenumber)) FILTER (l_returnflag IN ('R', 'A')) = 'R' AS open FROM w GROUP BY 1)
    SELECT m.k AS reg_key, vehicle_id, source_rows::BIGINT AS source_rows, coalesce(n_events, 0)::BIGINT AS n_events, last_visit, coalesce(open, false) AS is_open FROM m LEFT JOIN h USING (k)""")
def ctx_01(s, d):
    k = F.col("l_suppkey")
    plate = F.concat(F.lit("ap"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("q"), F.lpad((k % 10000).cast("string"), 4, "0"))
    workshop = notes(s, d).select(plate.alias("vehicle"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.lit("1").alias("odometer_km"), F.lit("m").alias("mechanic"), F.col("note").alias("notes"), F.col("l_linenumber").alias("_row"), F.concat(F.lit("o"), F.col("l_orderkey")).alias("_source"))
    nations = t(s, d, "nation").select(F.col("n_name").alias("hub"), F.col("n_name").alias("other"), F.lit(0.0).alias("km"))
    ctx, _ = build_context(registers.fleet(fleet_rows(s, d))[0], registers.maintenance(workshop, SECRET)[0], nations, registers.drivers(driver_rows(s, d), SECRET)[0], Rulebook())
    return ctx.vehicles.select("reg_key", "vehicle_id", "source_rows", "n_events", F.col("last_visit").cast("string").alias("last_visit"), "is_open")
