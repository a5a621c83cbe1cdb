"""Operator 12: ordered funnels counted by a backward fill over attempts and candidate rows, step by step, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table


@dataclass(frozen=True)
class Funnel:
    """Kinds in order, and the kind that ends an attempt."""

    steps: tuple[str, ...]
    excluded: str | None = None


#: The funnels of the query.
FUNNELS = {
    "A": Funnel(("view", "click", "view", "purchase"), "error"),
    "B": Funnel(("signup", "view", "click", "purchase"), "error"),
    "C": Funnel(("click", "click", "purchase", "view"), "signup"),
}
WITHIN = 30 * 60 * 1_000_000
#: A rank is looked for in two levels: this many ranges of the time that steps may take, then the times of one range.
RANGES = 2000


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds of a timestamp with or without a zone; one without is counted as it reads, so no session zone and no change of clocks alters a distance."""
    if dict(df.dtypes)[column] == "timestamp":
        return F.unix_micros(F.col(column))
    since = F.col(column).cast("timestamp_ntz") - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return (since.cast("interval second").cast("decimal(20, 6)") * F.lit(1_000_000)).cast("bigint")


def _chosen(by: Mapping[str, str | None], values: Mapping[str, Column]) -> Column:
    """For a row of each funnel the value of the kind that the funnel asks for; null where it asks for none."""
    cases = [(F.col("funnel") == name, values[kind]) for name, kind in by.items() if kind is not None]
    return reduce(lambda out, case: out.when(*case), cases, F) if cases else F.lit(None).cast("bigint")


def attempts(clicks: DataFrame, funnels: Mapping[str, Funnel], within: int = WITHIN, client: str = "client_id", kind: str = "kind", at: str = "arrived_at") -> DataFrame:
    """Rows (client, funnel, t1, took2 .. tookN): every first-step row, and the microseconds each later step took from the one before, null from the step on that was not reached.

    Rows are dealt by client and slice of time, two spans of `within` long; a row also goes to the slice before if an attempt begun there may still
    reach it. So a client with a third of all rows is as many tasks' work as it has slices, and whatever an attempt may need lies in its slice.
    Attempts and candidates are one set of rows, shuffled once. By falling time, attempts before candidates of equal time, the last value
    not null of a kind is the client's earliest row of that kind later than the attempt. A step moves its attempts to the row found, and the next step fills anew.
    """
    width = 2 * within
    raw = clicks.select(F.col(client).alias("client"), F.col(kind).alias("kind"), micros(clicks, at).alias("at")).filter("client is not null and kind is not null and at is not null")
    used = sorted({k for f in funnels.values() for k in (*f.steps, f.excluded) if k is not None})
    own = F.col("at") - F.pmod("at", F.lit(width))
    slices = F.array_compact(F.array(own, F.when(F.col("at") - own < within, own - width)))
    rows = raw.filter(F.col("kind").isin(used)).select("client", "kind", "at", F.explode(slices).alias("slice"))
    rows = rows.repartition("client", "slice").dropDuplicates(["client", "slice", "kind", "at"])

    most = max(len(f.steps) for f in funnels.values())
    took = [f"took{n}" for n in range(2, most + 1)]
    none = [F.lit(None).cast("bigint").alias(n) for n in took]
    candidate = F.struct("kind", "at", F.lit(None).cast("string").alias("funnel"), F.lit(None).cast("bigint").alias("t1"), F.lit(False).alias("open"), *none)
    home = F.col("at") - F.col("slice") < width
    begun = [F.when(home & (F.col("kind") == f.steps[0]), F.struct(F.lit(None).cast("string").alias("kind"), "at", F.lit(name).alias("funnel"), F.col("at").alias("t1"), F.lit(True).alias("open"), *none)) for name, f in funnels.items()]
    both = rows.select("client", "slice", F.explode(F.array_compact(F.array(candidate, *begun))).alias("x")).select("client", "slice", "x.*")

    back = Window.partitionBy("client", "slice").orderBy(F.desc("at"), F.col("funnel").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for n in range(2, most + 1):
        wanted = {name: f.steps[n - 1] if n <= len(f.steps) else None for name, f in funnels.items()}
        barred = {name: f.excluded for name, f in funnels.items()}
        kinds = sorted({k for k in (*wanted.values(), *barred.values()) if k is not None})
        filled = both.withColumns({f"__{i}": F.last(F.when(F.col("kind") == k, F.col("at")), ignorenulls=True).over(back) for i, k in enumerate(kinds)})
        later = {k: F.col(f"__{i}") for i, k in enumerate(kinds)}
        found = filled.withColumns({"__next": _chosen(wanted, later), "__bar": _chosen(barred, later)})
        reached = F.coalesce(F.col("open") & (F.col("__next") - F.col("t1") <= within) & (F.col("__bar").isNull() | (F.col("__bar") > F.col("__next"))), F.lit(False))
        kept = [F.when(reached, F.col("__next") - F.col("at")).alias(c) if c == f"took{n}" else F.col(c) for c in took]
        both = found.select("client", "slice", "kind", F.when(reached, F.col("__next")).otherwise(F.col("at")).alias("at"), "funnel", "t1", reached.alias("open"), *kept)
    return both.filter("funnel is not null").select("client", "funnel", "t1", *took)


def count_funnels(clicks: DataFrame, funnels: Mapping[str, Funnel], within: int = WITHIN, percent: int = 90, client: str = "client_id", kind: str = "kind", at: str = "arrived_at") -> DataFrame:
    """Rows (funnel, client, n1 .. nN, deepest, t2 .. tN, same_depth) for every client with attempts.

    n: attempts that reach a step; deepest: the last step that any reached; t: the ceil(percent * n / 100)-th smallest time of a step in microseconds,
    null if none; same_depth: clients of equal funnel and deepest, itself included. Rows with a null in one of the three columns
    are left out, repeated ones count once, and nothing else of a row matters. An empty table gives an empty result.

    Equal times are counted before anything is shuffled. The wanted rank is found first among RANGES ranges of time, then among the times
    of one range, so no task sees more rows of a client than there are ranges, or different microseconds in a range. Depths are counted by partial sums;
    the counts that are broadcast are at most one for each funnel and step.
    """
    most = max(len(f.steps) for f in funnels.values())
    each = F.array_compact(F.array(F.struct(F.lit(1).alias("step"), F.lit(0).cast("bigint").alias("took")), *(F.when(F.col(f"took{n}").isNotNull(), F.struct(F.lit(n).alias("step"), F.col(f"took{n}").alias("took"))) for n in range(2, most + 1))))
    long = attempts(clicks, funnels, within, client, kind, at).select("funnel", "client", F.explode(each).alias("x")).select("funnel", "client", "x.*")
    keys = ["funnel", "client", "step"]
    times = settle(long.groupBy(*keys, "took").agg(F.count("*").alias("n")).withColumn("range", F.expr(f"took div {-(-within // RANGES)}")))

    def first_at(rows: DataFrame, keys: list[str], order: str, rank: Column) -> DataFrame:
        """Of each key the row in order at which the running sum of n reaches the rank; before: the sum up to it."""
        upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        summed = rows.withColumn("__upto", upto).withColumn("before", F.col("__upto") - F.col("n"))
        return summed.filter((F.col("before") < rank) & (rank <= F.col("__upto"))).drop("__upto")

    ranges = times.groupBy(*keys, "range").agg(F.sum("n").alias("n"))
    total = ranges.withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    rank = F.expr(f"(total * {percent} + 99) div 100")
    spot = first_at(total, keys, "range", rank).select(*keys, "range", "total", (rank - F.col("before")).alias("rest"))
    fine = times.join(spot.hint("merge"), [*keys, "range"])
    found = first_at(fine, [*keys, "range"], "took", F.col("rest"))
    of = lambda n, c: F.max(F.when(F.col("step") == n, F.col(c)))
    counts = [F.coalesce(of(n, "total"), F.lit(0)).alias(f"n{n}") for n in range(1, most + 1)]
    per_client = settle(found.groupBy("funnel", "client").agg(*counts, F.max("step").alias("deepest"), *(of(n, "took").alias(f"t{n}") for n in range(2, most + 1))))
    depths = per_client.groupBy("funnel", "deepest").agg(F.count("*").alias("same_depth"))  # a row for each funnel and step at most
    return per_client.join(F.broadcast(depths), ["funnel", "deepest"]).select("funnel", F.col("client").alias(client), *(f"n{n}" for n in range(1, most + 1)), "deepest", *(f"t{n}" for n in range(2, most + 1)), "same_depth")


def op12_ordered_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_funnels(table(spark, sf_dir, "clicks"), FUNNELS)


def funnels_sql(funnels: Mapping[str, Funnel] = FUNNELS, within_minutes: int = 30, percent: int = 90) -> str:
    """The same in DuckDB's SQL, by as-of joins to the next row of each kind; funnels of equal length."""
    most = len(next(iter(funnels.values())).steps)
    with_, ends = ["d AS (SELECT DISTINCT client_id, kind, arrived_at AS tm FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND arrived_at IS NOT NULL)"], []
    for name, f in funnels.items():
        with_.append(f"{name}1 AS (SELECT client_id, tm AS t1 FROM d WHERE kind = '{f.steps[0]}')")
        for n in range(2, most + 1):
            with_.append(f"""{name}{n} AS (SELECT a.*, c.tm AS t{n} FROM {name}{n - 1} a ASOF JOIN (SELECT client_id, tm FROM d WHERE kind = '{f.steps[n - 1]}') c ON a.client_id = c.client_id AND a.t{n - 1} < c.tm
                ASOF LEFT JOIN (SELECT client_id, tm FROM d WHERE kind = '{f.excluded}') e ON a.client_id = e.client_id AND a.t{n - 1} < e.tm
                WHERE c.tm <= a.t1 + INTERVAL {within_minutes} MINUTE AND (e.tm IS NULL OR e.tm > c.tm))""")
        ends += [f"SELECT '{name}' AS funnel, client_id, {n} AS step, {f'epoch_us(t{n}) - epoch_us(t{n - 1})' if n > 1 else '0'} AS took FROM {name}{n}" for n in range(1, most + 1)]
    with_.append("x AS (" + " UNION ALL ".join(ends) + ")")
    with_.append("r AS (SELECT *, row_number() OVER (PARTITION BY funnel, client_id, step ORDER BY took) AS nth, count(*) OVER (PARTITION BY funnel, client_id, step) AS n FROM x)")
    counts = ", ".join(f"count(*) FILTER (step = {n})::BIGINT AS n{n}" for n in range(1, most + 1))
    times = ", ".join(f"max(took) FILTER (step = {n} AND nth = ({percent} * n + 99) // 100) AS t{n}" for n in range(2, most + 1))
    with_.append(f"g AS (SELECT funnel, client_id, {counts}, max(step)::INTEGER AS deepest, {times} FROM r GROUP BY 1, 2)")
    return "WITH " + ", ".join(with_) + " SELECT *, count(*) OVER (PARTITION BY funnel, deepest)::BIGINT AS same_depth FROM g"
