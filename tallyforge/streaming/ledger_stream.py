"""Tickets from a landing folder into the ledger, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tallyforge.operators.ledger import Ledger, new_rows
from tallyforge.scratch import settle

#: Appended parts after which they are dealt out into buckets.
MOST_PARTS = 64


def stream_into_ledger(spark: SparkSession, landing: str, schema: str, ledger: Ledger, split: Callable[[DataFrame], tuple[DataFrame, DataFrame]], checkpoint: str, key: str) -> StreamingQuery:
    """Each micro-batch is split into accepted and quarantined rows and merged.

    Merging is idempotent by key, so a batch that is replayed after a failure changes nothing: exactly once by effect. A batch
    appends its new rows; parts are dealt out into buckets where a quarantined key is accepted, and after MOST_PARTS parts.
    """

    def run(batch: DataFrame, _: int) -> None:
        accepted, quarantine = split(batch)
        old_a, old_q = ledger.load("accepted"), ledger.load("quarantine")
        old_a, old_q = accepted.limit(0) if old_a is None else old_a, quarantine.limit(0) if old_q is None else old_q
        accepted, quarantine = settle(new_rows(accepted.dropDuplicates([key]), old_a, key)), settle(new_rows(quarantine.dropDuplicates([key]), old_q, key))
        recovered = not old_q.join(accepted.select(key), key, "left_semi").isEmpty()
        if recovered or ledger.parts() >= MOST_PARTS:
            ledger.upsert(key, accepted, quarantine)
        else:
            fresh = quarantine.join(old_a.select(key), key, "left_anti").join(accepted.select(key), key, "left_anti")
            ledger.append(accepted=accepted, quarantine=fresh)

    return spark.readStream.schema(schema).json(landing).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
