"""Approval of drafted messages: one by one as a person answers, or as a table of answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.scratch import settle

from .ledger import Ledger, accepted_now


def approve_one(ledger: Ledger, key: str, value: str, approved_by: str, sent_at: str) -> str:
    """LED-04: not_found, no_message, already_sent or ok; only ok changes the ledger, by one appended row."""
    accepted = accepted_now(ledger, key)
    row = accepted.filter(F.col(key) == value).first() if accepted is not None else None
    if row is None:
        return "not_found"
    if "mailbox" in accepted.columns and row["mailbox"] is None:
        return "no_message"
    if "sent" in accepted.columns and row["sent"]:
        return "already_sent"
    approvals = accepted.sparkSession.createDataFrame([(value, approved_by, sent_at, row["mailbox"] if "mailbox" in accepted.columns else None, None)], f"{key} string, approved_by string, sent_at string, recipient string, body string")
    ledger.append(approvals=approvals)
    return "ok"


def approval_session(pending: DataFrame, answer: Callable[[object], str], approved_by: str, sent_at: str) -> DataFrame:
    """LED-03: ask for each pending message, in order, y, N or s (stop); gives the approvals. A person answers, so rows come one by one, and nothing ends the session but s or the last row."""
    given = []
    for row in pending.orderBy("ticket_id").toLocalIterator():
        said = answer(row).strip().lower()
        if said == "s":
            break
        if said == "y":
            given.append((row.ticket_id, approved_by, sent_at, row.recipient, row.body))
    return pending.sparkSession.createDataFrame(given, "ticket_id string, approved_by string, sent_at string, recipient string, body string")


def answered(pending: DataFrame, answers: DataFrame, approved_by: str, sent_at: str) -> DataFrame:
    """LED-03 for a table of answers (ticket_id, answer): the approvals that the session gives where these are said, in the order of ticket_id: y approves, the first s stops; whoever is not answered stays pending.

    Two joins and one minimum; no order of all rows is needed. One answer a ticket.
    """
    said = pending.join(answers.select("ticket_id", F.lower(F.trim("answer")).alias("__said")), "ticket_id")
    stop = said.filter("__said = 's'").agg(F.min("ticket_id").alias("__stop"))  # one row
    given = said.filter("__said = 'y'").join(F.broadcast(stop), F.col("__stop").isNull() | (F.col("ticket_id") < F.col("__stop")))
    return given.select("ticket_id", F.lit(approved_by).alias("approved_by"), F.lit(sent_at).alias("sent_at"), "recipient", "body")


def approve_all(ledger: Ledger, key: str, asked: DataFrame, approved_by: str, sent_at: str) -> DataFrame:
    """LED-04 for a table of keys: (key, said, n): how often each was asked for, and what became of it; keys that are ok are appended as approvals at once, so asking again gives already_sent.

    A key that is asked for often is one row before it meets the ledger. Null keys are not found.
    """
    times = asked.groupBy(key).agg(F.count("*").alias("n"))
    accepted = accepted_now(ledger, key)
    if accepted is None:
        return times.select(key, F.lit("not_found").alias("said"), "n")
    mailbox = F.col("mailbox") if "mailbox" in accepted.columns else F.lit("")
    sent = F.coalesce("sent", F.lit(False)) if "sent" in accepted.columns else F.lit(False)
    known = accepted.select(key, mailbox.alias("__mailbox"), sent.alias("__sent"), F.lit(True).alias("__known"))
    said = F.when(F.col("__known").isNull(), "not_found").when(F.col("__mailbox").isNull(), "no_message").when(F.col("__sent"), "already_sent").otherwise("ok")
    verdicts = settle(times.join(known, key, "left").select(key, said.alias("said"), "n", "__mailbox"))
    recipient = F.col("__mailbox") if "mailbox" in accepted.columns else F.lit(None).cast("string")
    ledger.append(approvals=verdicts.filter("said = 'ok'").select(key, F.lit(approved_by).alias("approved_by"), F.lit(sent_at).alias("sent_at"), recipient.alias("recipient"), F.lit(None).cast("string").alias("body")))
    return verdicts.select(key, "said", "n")
