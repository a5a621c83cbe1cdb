"""Entity resolution: precedence merges, conflicts, event rollups, open states, point-in-time state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_with_precedence(rows: DataFrame, key: str, order: Sequence[Column], fields: Sequence[str]) -> DataFrame:
    """AGG-01, WIN-07: one row a key; each field comes from the first row in order that has it.

    One aggregation, partial before the shuffle: no window, no sort.
    """
    place = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    return rows.groupBy(key).agg(*(F.min_by(F.col(f), F.when(F.col(f).isNotNull(), place)).alias(f) for f in fields), F.count("*").alias("source_rows"))


def conflicts(rows: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """AGG-02: (key, field, n_values, values) of fields for which a key's rows disagree; blanks do not count."""
    long = rows.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("x")).select(key, "x.field", "x.value")
    found = long.filter("value is not null and value <> ''").groupBy(key, "field").agg(F.collect_set("value").alias("values"))
    return found.filter(F.size("values") > 1).select(key, "field", F.size("values").cast("bigint").alias("n_values"), F.array_join(F.array_sort("values"), "|").alias("values"))


def event_rollup(events: DataFrame, key: str, when: str, value: str) -> DataFrame:
    """AGG-03, WIN-03: count, last time and the value that comes with it (the greatest of equal times)."""
    return events.groupBy(key).agg(F.count("*").alias("n_events"), F.max(when).alias("last_at"), F.max_by(value, F.struct(when, value)).alias("last_value"))


def open_state(events: DataFrame, key: str, when: Sequence[str], opens: Column, closes: Column) -> DataFrame:
    """AGG-05: whether a key's latest opening event has no closing one after it.

    The two kinds exclude each other, so the latest of either decides; no ordered pass is needed.
    """
    marked = events.withColumn("__open", opens).filter(opens | closes)
    return marked.groupBy(key).agg(F.max_by("__open", F.struct(*when)).alias("is_open"), F.max(F.when(F.col("__open"), F.col(when[0]))).alias("last_open_at"))


#: Where a key's rows begin that no time is known of.
FIRST = "0001-01-01"


def _slice(at: Column, unit: str) -> Column:
    return F.coalesce(F.date_trunc(unit, at), F.lit(FIRST).cast("timestamp"))


def _carried(parts: DataFrame, key: Sequence[str], place: str, carry: dict[str, Column]) -> DataFrame:
    """For each part of a key (a row each) what the parts before it hand over; a window of as many rows as a key has parts."""
    before = Window.partitionBy(*key).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*key, place, *(how.over(before).alias(name) for name, how in carry.items()))


def regressions(events: DataFrame, key: str, order: Sequence[str], value: str, slice_: str | Column = "month") -> DataFrame:
    """WIN-02: rows whose value is below the key's last one that is not null, with it as previous.

    A key is cut into slices of its order, so that none is one task's work: the lag runs within a slice, and the first row of a slice gets the last
    value of the slices before, one row a key and slice. slice_: a unit of date_trunc for the first column of the order, or a column that never falls in that order.
    """
    cut = _slice(F.col(order[0]).cast("timestamp"), slice_) if isinstance(slice_, str) else slice_
    known = events.filter(F.col(value).isNotNull()).withColumn("__slice", cut)
    ends = known.groupBy(key, "__slice").agg(F.max_by(value, F.struct(*order)).alias("__end"))
    starts = _carried(ends, [key], "__slice", {"__before": F.last("__end")}).withColumnsRenamed({key: "__key", "__slice": "__from"})
    w = Window.partitionBy(key, "__slice").orderBy(*order)
    inside = known.withColumn("__lag", F.lag(value).over(w)).join(starts, F.col(key).eqNullSafe(F.col("__key")) & F.col("__slice").eqNullSafe(F.col("__from")))
    return inside.withColumn("previous", F.coalesce("__lag", "__before")).filter(F.col(value) < F.col("previous")).select(*events.columns, "previous")


def as_of(probes: DataFrame, events: DataFrame, key: str, probe_at: str, event_at: str, latest: dict[str, Column], totals: dict[str, Column] | None = None, slice_: str = "month") -> DataFrame:
    """JOIN-07, JOIN-08: each probe with what its key's events not after it say.

    latest: columns of events of which the greatest value counts; a struct that begins with the time is the latest event's, and what follows in it comes along
    (null where an event is none of the kind). totals: numbers that are added up, 0 without events. Linear in both sides, where a join on "not after" grows with their
    product, and no task holds a whole key: events are reduced by key and slice of time, running values over those stand at the beginning of each slice like an event,
    and a window over a slice's probes and events does the rest. Events without a time come before all others. Probes are read twice; give a settled table where they cost much.
    """
    totals = totals or {}
    how = {**{k: F.max for k in latest}, **{k: F.sum for k in totals}}
    right = events.select(F.col(key).alias("__key"), F.coalesce(F.col(event_at).cast("timestamp"), F.lit(FIRST).cast("timestamp")).alias("__at"), *(v.alias(f"__{k}") for k, v in {**latest, **totals}.items()))
    right = right.withColumn("__slice", _slice(F.col("__at"), slice_))
    left = probes.withColumns({"__key": F.col(key), "__at": F.col(probe_at).cast("timestamp")}).withColumn("__slice", _slice(F.col("__at"), slice_))
    sums = right.groupBy("__key", "__slice").agg(*(f(f"__{k}").alias(f"__{k}") for k, f in how.items()))
    marks = left.select("__key", "__slice").distinct()
    parts = sums.unionByName(marks, allowMissingColumns=True).groupBy("__key", "__slice").agg(*(f(f"__{k}").alias(f"__{k}") for k, f in how.items()))
    starts = _carried(parts, ["__key"], "__slice", {f"__c_{k}": f(f"__{k}") for k, f in how.items()})
    begin = starts.select("__key", "__slice", F.col("__slice").alias("__at"), F.lit(-1).alias("__probe"), *(F.col(f"__c_{k}").alias(f"__{k}") for k in how))
    both = left.withColumn("__probe", F.lit(1)).unionByName(right.withColumn("__probe", F.lit(0)), allowMissingColumns=True).unionByName(begin, allowMissingColumns=True)
    w = Window.partitionBy("__key", "__slice").orderBy("__at", "__probe").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({f"__w_{k}": f(f"__{k}").over(w) for k, f in how.items()}).filter("__probe = 1")
    return seen.select(*probes.columns, *(F.col(f"__w_{k}").alias(k) for k in latest), *(F.coalesce(f"__w_{k}", F.lit(0)).alias(k) for k in totals))


def as_of_state(probes: DataFrame, events: DataFrame, key: str, probe_at: str, event_at: str, facts: dict[str, Column], slice_: str = "month") -> DataFrame:
    """JOIN-07: for each probe, the latest time not after it at which each fact held, by key. facts: conditions on event columns by result name."""
    return as_of(probes, events, key, probe_at, event_at, {k: F.when(c, F.col(event_at)).cast("timestamp") for k, c in facts.items()}, slice_=slice_)


def prior_incidents(probes: DataFrame, incidents: DataFrame, key: str, probe_at: str, slice_: str = "month") -> DataFrame:
    """JOIN-08: each probe with n_incidents and latest_incident (at, ticket_id, citation) of its key's incidents (key, at, ticket_id, citation) not after it; of equal times the greatest id."""
    return as_of(probes, incidents, key, probe_at, "at", {"latest_incident": F.struct("at", "ticket_id", "citation")}, {"n_incidents": F.lit(1).cast("bigint")}, slice_)


def global_rank(rows: DataFrame, order: str, place: str) -> DataFrame:
    """SRT-02: rows with their place in the order of a column, binary and from 1: a range sort, and counts of the ranges before; no task sees all rows.

    Equal values get their places in any order.
    """
    from tallyforge.scratch import settle

    ranged = settle(rows.repartitionByRange(order).withColumn("__range", F.spark_partition_id()))
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))  # a row a range
    before = counts.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__range").orderBy(order))
    return ranged.join(F.broadcast(before), "__range").select(*rows.columns, (F.col("__before") + nth).cast("bigint").alias(place))


def event_sequence(events: DataFrame, key: str, when: str, citation: Column) -> DataFrame:
    """WIN-01: events with their place by date, those without one first, and citation.

    Places are counted within a key's months and go on from the months before, so no task orders a whole key.
    """
    marked = events.withColumn("__date", F.coalesce(F.date_format(when, "yyyy-MM-dd"), F.lit(""))).withColumn("__slice", F.substring("__date", 1, 7))
    counts = marked.groupBy(key, "__slice").agg(F.count("*").alias("__n"))
    starts = _carried(counts, [key], "__slice", {"__before": F.sum("__n")}).withColumnsRenamed({key: "__key", "__slice": "__from"})
    inside = marked.withColumn("__nth", F.row_number().over(Window.partitionBy(key, "__slice").orderBy("__date", citation)))
    placed = inside.join(starts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__slice") == F.col("__from")))
    return placed.select(*events.columns, (F.coalesce("__before", F.lit(0)) + F.col("__nth")).cast("bigint").alias("place"))
