"""Queries over tickets from validation to the outputs: lookups, candidates, decisions, quarantine, ledger, approvals, each through the library's functions."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import core as c
from tallyforge.operators import approvals, dedup, emit, ledger, reports, resolve, validate
from tallyforge.scratch import file_system, fresh, put_text, settle

from .bindings import FINGERPRINT, O_SQL, REASON_SQL, checked, dimensions, query, t, tickets

# ---- lookups


def looked_up(s, d, number: int, key: str, own, flag: str) -> DataFrame:
    return validate.known(tickets(s, d), dimensions(s, d)[number], key, own, flag)


@query("join_03", f"WITH {O_SQL} SELECT k AS idx, CASE WHEN k % 11 <> 0 THEN 'V' || k % 150 ELSE '' END AS reg_key, CASE WHEN k % 11 = 0 THEN 'MISSING_VEHICLE' WHEN k % 150 >= 100 THEN 'UNKNOWN_VEHICLE' END AS reason FROM o")
def join_03(s, d):
    key = c.reg_key("vehicle")
    reason = F.when(key == "", "MISSING_VEHICLE").when(~F.col("known_vehicle"), "UNKNOWN_VEHICLE")
    return looked_up(s, d, 0, "reg_key", key, "known_vehicle").select("idx", key.alias("reg_key"), reason.alias("reason"))


@query("join_04", f"WITH {O_SQL} SELECT k AS idx, CASE WHEN k % 13 = 0 THEN 'Atlantis' ELSE 'hub' || c_nationkey END AS origin_hub, k % 13 <> 0 AS known_hub FROM o")
def join_04(s, d):
    return looked_up(s, d, 1, "hub", F.col("origin_hub"), "known_hub").select("idx", "origin_hub", "known_hub")


@query("join_05", f"WITH {O_SQL} SELECT k AS idx, 'D' || k % 40 AS driver_id, CASE WHEN k % 40 >= 30 THEN 'UNKNOWN_DRIVER' END AS finding FROM o WHERE k % 3 = 0")
def join_05(s, d):
    rows = looked_up(s, d, 2, "driver_id", F.col("driver_id"), "known_driver").filter("driver_id is not null")
    return rows.select("idx", "driver_id", F.when(~F.col("known_driver"), "UNKNOWN_DRIVER").alias("finding"))


@query("join_06", f"WITH {O_SQL} SELECT k AS idx, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '36' WHEN 'BUILDING' THEN '48' END AS sla_hours, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'desk@auto.example' END AS mailbox FROM o")
def join_06(s, d):
    config = s.createDataFrame([("AUTOMOBILE", 36, "desk@auto.example"), ("BUILDING", 48, None)], "client string, sla_hours int, mailbox string")  # a configuration
    return tickets(s, d).join(F.broadcast(config), "client", "left").select("idx", F.col("sla_hours").cast("string").alias("sla_hours"), "mailbox")


@query("join_12", "WITH a AS (SELECT l_suppkey % 12 AS rule_id, l_returnflag FROM lineitem), r AS (SELECT unnest(range(14)) AS rule_id) SELECT r.rule_id, count(l_returnflag)::BIGINT AS n_audited FROM r LEFT JOIN a USING (rule_id) GROUP BY 1")
def join_12(s, d):
    """Rules without a single audit row stay."""
    audit = t(s, d, "lineitem").groupBy((F.col("l_suppkey") % 12).alias("rule_id")).agg(F.count("*").alias("n_audited"))
    return s.range(14).withColumnRenamed("id", "rule_id").join(audit, "rule_id", "left").fillna(0, ["n_audited"])


# ---- order and best records


@query("win_01", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY strftime(l_shipdate, '%Y-%m-%d'), lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '#' || l_linenumber) AS place FROM lineitem")
def win_01(s, d):
    citation = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lit("#"), F.col("l_linenumber"))
    return resolve.event_sequence(t(s, d, "lineitem"), "l_suppkey", "l_shipdate", citation).select("l_orderkey", "l_linenumber", "place")


@query("win_04", f"""WITH f AS (SELECT {FINGERPRINT} AS fingerprint, doc_id, CAST(lang <> 'en' AS INTEGER) + CAST(source <> 'src0' AS INTEGER) AS filled, substr(sha256('t=' || text || '|s=' || source), 1, 16) AS h FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY filled DESC, h, doc_id) AS nth FROM f) SELECT fingerprint, doc_id, CAST(filled AS BIGINT) AS filled FROM r WHERE nth = 1""")
def win_04(s, d):
    fields = [F.when(F.col("lang") != "en", F.col("lang")), F.when(F.col("source") != "src0", F.col("source"))]
    docs = t(s, d, "documents").select(c.fingerprint("text").alias("fingerprint"), "doc_id", c.completeness(fields).cast("bigint").alias("filled"), c.material_hash({"t": F.col("text"), "s": F.col("source")}).alias("h"))
    return dedup.best_record(docs, ["fingerprint"], [F.desc("filled"), F.col("h"), F.col("doc_id")]).drop("h")


@query("lim_02", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS nth FROM events WHERE value IS NOT NULL) WHERE nth = 1")
def lim_02(s, d):
    return dedup.best_record(t(s, d, "events").filter("value is not null").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.col("event_id")]).drop("value")


@query("win_06", "WITH a AS (SELECT event_id, list_filter(['INGESTED', CASE WHEN event_type = 'error' THEN 'RULE_EVALUATED' END, CASE WHEN event_type <> 'view' THEN 'CLASSIFIED' END, 'EMITTED'], lambda x: x IS NOT NULL) AS s FROM events) SELECT event_id, CAST(unnest(range(1, len(s) + 1)) AS BIGINT) AS seq, unnest(s) AS step FROM a")
def win_06(s, d):
    yes, kind = F.lit(True), F.col("event_type")
    steps = [("INGESTED", yes, kind), ("RULE_EVALUATED", kind == "error", kind), ("CLASSIFIED", kind != "view", kind), ("EMITTED", yes, kind)]
    return emit.audit(t(s, d, "events"), "event_id", steps).select("event_id", "seq", "step")


# ---- validation and quarantine

HASH_SQL = """substr(sha256('created_at=' || CASE WHEN k % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') ELSE 'soon' END || '|vehicle=' || CASE WHEN k % 11 <> 0 THEN 'v-' || k % 150 ELSE '' END || '|driver_id=' || CASE WHEN k % 3 = 0 THEN 'D' || k % 40 ELSE '' END
    || '|origin_hub=' || CASE WHEN k % 13 = 0 THEN 'Atlantis' ELSE 'hub' || c_nationkey END || '|km_from_origin_hub=' || CASE WHEN k % 17 <> 0 THEN CAST(k % 100 - 5 AS VARCHAR) ELSE '' END || '|destination=' || CASE WHEN k % 19 <> 0 THEN 'hub1' ELSE '' END || '|issue=tyre burst|severity='
    || CASE WHEN k % 5 = 0 THEN 'SEVERE' ELSE 'HIGH' END || '|client=' || c_mktsegment), 1, 16)"""
BATCH_SQL = f"{O_SQL}, v AS (SELECT CASE WHEN k % 23 = 0 THEN 'NO-ID-' || {HASH_SQL} ELSE 'T-' || k END AS batch_id, k, {REASON_SQL} AS reasons FROM o), b AS (SELECT batch_id, arg_min(reasons, k) AS reasons, count(*)::BIGINT AS occurrences, min(k) AS first FROM v GROUP BY 1)"


def batch(s, d) -> DataFrame:
    return validate.validate_batch(tickets(s, d), *dimensions(s, d))


@query("dup_03", f"WITH {BATCH_SQL} SELECT batch_id, reasons, reasons = '' AS accepted, occurrences FROM b")
def dup_03(s, d):
    return batch(s, d).select("batch_id", F.array_join("reason_codes", ",").alias("reasons"), "accepted", "occurrences")


REMEDY_SQL = "concat_ws('|', " + ", ".join("CASE WHEN " + " OR ".join(f"contains(reasons, '{code}')" for code in codes) + f" THEN '{text}' END" for codes, text in validate.REMEDIES) + ")"


@query("prj_18", f"WITH {O_SQL}, x AS (SELECT k AS idx, {REASON_SQL} AS reasons FROM o) SELECT idx, {REMEDY_SQL} AS remediation FROM x")
def prj_18(s, d):
    return checked(s, d).select("idx", F.array_join(validate.remediation(validate.reasons()), "|").alias("remediation"))


def held(s, d) -> DataFrame:
    return validate.quarantine_records(batch(s, d), F.to_json(F.struct("idx")), c.cite(F.lit("orders"), "idx"))


@query("dup_04", f"""WITH {BATCH_SQL} SELECT batch_id AS quarantine_id, CASE WHEN NOT starts_with(batch_id, 'NO-ID-') THEN batch_id END AS ticket_id, reasons, occurrences, 'orders#' || first AS citation, {REMEDY_SQL} AS remediation, '{{"idx":' || first || '}}' AS raw_record FROM b WHERE reasons <> ''""")
def dup_04(s, d):
    return held(s, d).select("quarantine_id", "ticket_id", F.array_join("reason_codes", ",").alias("reasons"), "occurrences", "citation", F.array_join("remediation", "|").alias("remediation"), "raw_record")


@query("emt_03", f"WITH {BATCH_SQL} SELECT batch_id AS quarantine_id, len(string_split(reasons, ',')) AS n_reasons, occurrences FROM b WHERE reasons <> ''")
def emt_03(s, d):
    """Saved in a ledger, loaded, projected."""
    book = ledger.Ledger(s, fresh(s, "ledger"))
    book.save(quarantine=held(s, d))
    return emit.quarantine(book.load("quarantine")).select("quarantine_id", F.size("reason_codes").cast("bigint").alias("n_reasons"), "occurrences")


# ---- the ledger and its projections

MAILBOXES = {"AUTOMOBILE": "desk@auto.example", "FURNITURE": "desk@furniture.example", "HOUSEHOLD": "desk@household.example", "BUILDING": "desk@building.example"}
ACC_SQL = """a AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS ticket_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'Internal' WHEN 'MACHINERY' THEN '' ELSE c_mktsegment END AS client, CASE WHEN c_mktsegment <> 'MACHINERY' THEN 'desk@' || CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'auto' ELSE lower(c_mktsegment) END || '.example' END AS mailbox,
    'MSG-' || upper(substr(sha256('msg:' || o_orderkey), 1, 10)) AS message_id, 'WO-' || upper(substr(sha256('wo:' || o_orderkey), 1, 10)) AS work_order_id, o_orderkey % 3 = 0 AS sent,
    CASE WHEN o_orderstatus = 'F' THEN 'ESCALATED_NO_VEHICLE' WHEN o_totalprice > 200000 THEN 'DISPATCHED_WITH_CONSTRAINTS' ELSE 'DISPATCHED' END AS status, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_iso, 'V' || o_custkey AS vehicle_key FROM orders JOIN customer ON o_custkey = c_custkey)"""


def accepted(s, d) -> DataFrame:
    """Orders as rows of a ledger, one in three sent."""
    o = t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k, segment, sent = F.col("o_orderkey").cast("string"), F.col("c_mktsegment"), F.col("o_orderkey") % 3 == 0
    boxes = F.create_map(*(F.lit(x) for kv in MAILBOXES.items() for x in kv))
    status = emit.work_order_status(F.col("o_orderstatus") != "F", F.col("o_totalprice") > 200000)
    return o.select(k.alias("ticket_id"), F.when(segment == "BUILDING", "Internal").when(segment == "MACHINERY", "").otherwise(segment).alias("client"), F.try_element_at(boxes, segment).alias("mailbox"), c.prefixed_id("MSG-", "msg", k).alias("message_id"), c.prefixed_id("WO-", "wo", k).alias("work_order_id"), status.alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("created_iso"), F.concat(F.lit("V"), F.col("o_custkey")).alias("vehicle_key"), c.cite(F.lit("orders"), k).alias("citation"), sent.alias("sent"), *(F.when(sent, v).alias(n) for n, v in (("recipient", F.lit("desk@auto.example")), ("body", F.concat(F.lit("Sent "), k)), ("approved_by", F.lit("ann")), ("sent_at", F.lit("t1")))))


@query("prj_15", f"WITH {ACC_SQL} SELECT work_order_id, ticket_id, vehicle_key AS vehicle_reg, created_iso AS created_at, client, status FROM a")
def prj_15(s, d):
    return accepted(s, d).select("work_order_id", "ticket_id", F.col("vehicle_key").alias("vehicle_reg"), F.col("created_iso").alias("created_at"), "client", "status")


@query("prj_19", f"WITH {ACC_SQL} SELECT ticket_id, client, created_iso AS at, vehicle_key AS reg_key, 'orders#' || ticket_id AS citation FROM a")
def prj_19(s, d):
    return ledger.incident_seeds(accepted(s, d))


@query("flt_09", f"WITH {ACC_SQL} SELECT ticket_id, CASE WHEN sent THEN 'sent' ELSE 'pending' END AS place FROM a")
def flt_09(s, d):
    acc = accepted(s, d)
    return ledger.pending(acc).select("ticket_id", F.lit("pending").alias("place")).unionByName(ledger.sent(acc).select("ticket_id", F.lit("sent").alias("place")))


def _body():
    return emit.message([F.concat(F.lit("Ticket "), F.col("ticket_id")), F.lit(""), F.when(F.col("status") == "DISPATCHED", "On its way.")])


@query("emt_01", f"WITH {ACC_SQL} SELECT message_id, ticket_id, mailbox AS recipient, 'Ticket ' || ticket_id || chr(10) || CASE WHEN status = 'DISPATCHED' THEN chr(10) || 'On its way.' ELSE '' END AS body, created_iso AS drafted_at FROM a WHERE NOT sent AND client NOT IN ('', 'Internal') AND mailbox IS NOT NULL")
def emt_01(s, d):
    return emit.comms_pending(accepted(s, d), _body(), F.col("created_iso").alias("drafted_at"))


@query("emt_02", f"WITH {ACC_SQL} SELECT message_id, ticket_id, 'desk@auto.example' AS recipient, 'Sent ' || ticket_id AS body, 'ann' AS approved_by, 't1' AS sent_at FROM a WHERE sent")
def emt_02(s, d):
    return emit.comms_sent(accepted(s, d))


def trail(acc: DataFrame) -> DataFrame:
    yes = F.lit(True)
    return emit.audit(acc, "ticket_id", [("INGESTED", yes, F.col("citation")), ("WORK_ORDER_EMITTED", yes, F.col("work_order_id")), ("COMMS_SENT", F.col("sent"), F.col("approved_by"))])


@query("prj_20", f"""WITH {ACC_SQL}, x AS (SELECT *, list_filter(['INGESTED', 'WORK_ORDER_EMITTED', CASE WHEN sent THEN 'COMMS_SENT' END], lambda x: x IS NOT NULL) AS s FROM a) SELECT ticket_id, work_order_id, CAST(unnest(range(1, len(s) + 1)) AS BIGINT) AS seq, unnest(s) AS step FROM x""")
def prj_20(s, d):
    return reports.work_order_detail(accepted(s, d).select("ticket_id", "work_order_id"), trail(accepted(s, d)).drop("detail"), "ticket_id")


@query("agg_16", f"WITH {ACC_SQL}, {BATCH_SQL} SELECT (SELECT count(*) FROM a)::BIGINT AS accepted, (SELECT count(*) FROM a WHERE status = 'DISPATCHED')::BIGINT AS dispatched, (SELECT count(*) FROM a WHERE status = 'DISPATCHED_WITH_CONSTRAINTS')::BIGINT AS constrained, (SELECT count(*) FROM a WHERE status = 'ESCALATED_NO_VEHICLE')::BIGINT AS escalated, (SELECT count(*) FROM b WHERE reasons <> '')::BIGINT AS quarantined, (SELECT sum(occurrences) FROM b WHERE reasons <> '')::BIGINT AS held")
def agg_16(s, d):
    return reports.summary(accepted(s, d), held(s, d))


@query("agg_21", "SELECT regexp_extract(url, '://([^/:]+)', 1) AS host, count(*)::BIGINT AS n_files, sha256(string_agg(coalesce(sha256(html), '<missing>'), '' ORDER BY lpad(CAST(page_id AS VARCHAR), 12, '0'))) AS digest FROM pages GROUP BY 1")
def agg_21(s, d):
    files = t(s, d, "pages").select(F.regexp_extract("url", "://([^/:]+)", 1).alias("host"), F.lpad(F.col("page_id").cast("string"), 12, "0").alias("name"), "html")
    return reports.hash_files(files, "host", "name", F.col("html"))


@query("snk_04", f"""WITH {ACC_SQL}, {BATCH_SQL} SELECT 'work_orders' AS label, count(*)::BIGINT AS n FROM a UNION ALL SELECT 'comms_pending', count(*) FROM a WHERE NOT sent AND client NOT IN ('', 'Internal') AND mailbox IS NOT NULL UNION ALL SELECT 'comms_sent', count(*) FROM a WHERE sent
    UNION ALL SELECT 'quarantine', count(*) FROM b WHERE reasons <> '' UNION ALL SELECT 'audit', 2 * count(*) + count(*) FILTER (sent) FROM a UNION ALL SELECT 'written despite the gate', 0""")
def snk_04(s, d):
    """All five outputs leave with the mailboxes allowed; without, the gate holds and nothing is written."""
    acc, kept = settle(accepted(s, d)), settle(held(s, d))  # each goes into outputs that are written more than once
    audit = trail(acc).withColumn("key", F.concat_ws(" ", "ticket_id", "seq"))
    frames = {"work_orders": (acc.select("work_order_id", "ticket_id", "client", "status"), "ticket_id"), "comms_pending": (emit.comms_pending(acc, _body()), "ticket_id"), "comms_sent": (emit.comms_sent(acc), "ticket_id"), "quarantine": (emit.quarantine(kept), "quarantine_id"), "audit": (audit, "key")}
    good, bad = fresh(s, "outputs"), fresh(s, "outputs")
    emit.materialise(frames, good, allow=MAILBOXES.values())
    with contextlib.suppress(emit.GateError):
        emit.materialise(frames, bad)
    fs, where = file_system(s, bad)
    out = s.createDataFrame([("written despite the gate", int(fs.exists(where)))], "label string, n bigint")
    emit.materialise(frames, good, allow=MAILBOXES.values())  # again: a new version replaces the first as a whole
    for label, lines in emit.read_outputs(s, good).items():
        out = out.unionByName(lines.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n"))
    return out


@query("led_01_buckets", "SELECT CAST(o_orderkey AS VARCHAR) AS ticket_id, CASE WHEN o_orderkey % 2 = 0 THEN 'first' ELSE 'second' END AS origin, 'accepted' AS place FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 10 = 0 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'first', 'quarantine' FROM orders WHERE o_orderkey % 10 = 5")
def led_01_buckets(s, d):
    """Two batches over all orders into the ledger's buckets: even keys are accepted and odd ones held, then all but those of five are accepted and leave quarantine; a third changes nothing."""
    k = F.col("o_orderkey")
    rows = lambda name: t(s, d, "orders").select(k, k.cast("string").alias("ticket_id"), F.lit(name).alias("origin"))
    book = ledger.Ledger(s, fresh(s, "ledger"))
    for name, good in (("first", k % 2 == 0), ("second", k % 5 != 0), ("third", k % 5 != 0)):
        book.upsert("ticket_id", rows(name).filter(good).drop("o_orderkey"), rows(name).filter(~good).drop("o_orderkey"))
    return book.load("accepted").withColumn("place", F.lit("accepted")).unionByName(book.load("quarantine").withColumn("place", F.lit("quarantine")))


@query("snk_06", "SELECT 'saved' AS step, count(*)::BIGINT AS n FROM nation UNION ALL SELECT 'appended', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) UNION ALL SELECT 'other schema', -1 UNION ALL SELECT 'reset', 0")
def snk_06(s, d):
    book = ledger.Ledger(s, fresh(s, "ledger"))
    count = lambda: (df.count() if (df := book.load("accepted")) is not None else 0)
    book.save(accepted=t(s, d, "nation").select(F.col("n_name").alias("ticket_id")))
    said = [("saved", count())]
    book.append(accepted=t(s, d, "region").select(F.col("r_name").alias("ticket_id"), F.lit(1).alias("more")))
    said.append(("appended", count()))
    put_text(s, f"{book.path}/CURRENT", '{"schema_version": 99}')
    try:
        said.append(("other schema", count()))
    except ledger.LedgerError:
        said.append(("other schema", -1))
    book.reset()
    return s.createDataFrame([*said, ("reset", count())], "step string, n bigint")


@query("led_03", "SELECT lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS ticket_id, 'ann' AS approved_by, 't1' AS sent_at, 'desk@auto.example' AS recipient, n_name AS body FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey < 20")
def led_03(s, d):
    """A session that answers y to every third message and stops at the twentieth."""
    pending = t(s, d, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("ticket_id"), F.lit("desk@auto.example").alias("recipient"), F.col("n_name").alias("body"))
    answer = lambda row: "s" if int(row.ticket_id) == 20 else " Y " if int(row.ticket_id) % 3 == 0 else ""
    return approvals.approval_session(pending, answer, "ann", "t1")


@query("led_04", "SELECT * FROM (VALUES ('a missing one', 'not_found'), ('one without mailbox', 'no_message'), ('first', 'ok'), ('again', 'already_sent')) AS v(what, said) UNION ALL SELECT 'sent in the end', CAST(1 + count(*) FILTER (n_nationkey % 3 = 0) AS VARCHAR) FROM nation")
def led_04(s, d):
    k = F.col("n_nationkey")
    book = ledger.Ledger(s, fresh(s, "ledger"))
    book.save(accepted=t(s, d, "nation").select(k.cast("string").alias("ticket_id"), F.when(k != 1, "desk@auto.example").alias("mailbox"), *(F.when(k % 3 == 0, v).alias(n) for n, v in (("approved_by", "bo"), ("sent_at", "t0"), ("recipient", "r"), ("body", "b")))).withColumn("sent", F.col("sent_at").isNotNull()))
    said = [(what, approvals.approve_one(book, "ticket_id", key, "ann", "t1")) for what, key in (("a missing one", "99"), ("one without mailbox", "1"), ("first", "2"), ("again", "2"))]
    return s.createDataFrame([*said, ("sent in the end", str(ledger.accepted_now(book, "ticket_id").filter("sent").count()))], "what string, said string")


ASKED_SQL = "CASE WHEN CAST(ticket_id AS BIGINT) % 4 = 1 THEN ' Y ' WHEN vehicle_key = (SELECT max(vehicle_key) FROM a) THEN 's' ELSE 'n' END"


@query("led_03_answers", f"WITH {ACC_SQL}, p AS (SELECT *, {ASKED_SQL} AS answer FROM a WHERE NOT sent AND client NOT IN ('', 'Internal') AND mailbox IS NOT NULL) SELECT ticket_id, 'ann' AS approved_by, 't2' AS sent_at, mailbox AS recipient, 'Ticket ' || ticket_id || chr(10) || CASE WHEN status = 'DISPATCHED' THEN chr(10) || 'On its way.' ELSE '' END AS body FROM p WHERE answer = ' Y ' AND ticket_id < coalesce((SELECT min(ticket_id) FROM p WHERE answer = 's'), 'x')")
def led_03_answers(s, d):
    """Every pending message of all orders is answered; the session stops at the first of the vehicle that asks for it."""
    acc = accepted(s, d)
    last = acc.agg(F.max("vehicle_key").alias("last"))  # one row
    answer = F.when(F.col("ticket_id").cast("bigint") % 4 == 1, " Y ").when(F.col("vehicle_key") == F.col("last"), "s").otherwise("n")
    answers = acc.crossJoin(F.broadcast(last)).select("ticket_id", answer.alias("answer"))
    return approvals.answered(emit.comms_pending(acc, _body()), answers, "ann", "t2")


@query("led_04_answers", f"WITH {ACC_SQL}, q AS (SELECT CAST(l_orderkey + l_linenumber // 7 * 1000000000 AS VARCHAR) AS ticket_id, count(*)::BIGINT AS n FROM lineitem GROUP BY 1), v AS (SELECT q.ticket_id, n, CASE WHEN a.ticket_id IS NULL THEN 'not_found' WHEN mailbox IS NULL THEN 'no_message' WHEN sent THEN 'already_sent' ELSE 'ok' END AS said FROM q LEFT JOIN a ON q.ticket_id = a.ticket_id) SELECT ticket_id, said, CASE WHEN said = 'ok' THEN 'already_sent' ELSE said END AS again, n FROM v")
def led_04_answers(s, d):
    """Each line asks for its order's message, some for orders that are not there; then all ask once more."""
    book = ledger.Ledger(s, fresh(s, "ledger"))
    book.save(accepted=accepted(s, d))
    asked = t(s, d, "lineitem").select((F.col("l_orderkey") + F.floor(F.col("l_linenumber") / 7) * 1000000000).cast("string").alias("ticket_id"))
    first = approvals.approve_all(book, "ticket_id", asked, "ann", "t2")
    again = approvals.approve_all(book, "ticket_id", asked, "bo", "t3")
    return first.join(again.select("ticket_id", F.col("said").alias("again")), "ticket_id").select("ticket_id", "said", "again", "n")
