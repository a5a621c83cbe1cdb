"""Four-valued rules as columns. A verdict is never a bare boolean, so a null cannot pass for PASS."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.core import days_between, in_hours, months_between, padded_hours

PASS, FAIL, NOT_APPLICABLE, INSUFFICIENT = "PASS", "FAIL", "NOT_APPLICABLE", "INSUFFICIENT_DATA"


def result(rule_id: str, verdict: Column, hard: bool, because: Column | str = "", derived: Column | bool = False, evidence: Mapping[str, Column] | None = None, name: str = "", citations: Sequence[str] = (), assumptions: Sequence[str] = ()) -> Column:
    """The uniform result of a rule."""
    text = lambda x: F.lit(x) if isinstance(x, (str, bool)) else x
    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    facts = F.to_json(F.struct(*(v.cast("string").alias(k) for k, v in sorted((evidence or {}).items()))), {"ignoreNullFields": "false"}) if evidence else F.lit("{}")
    return F.struct(F.lit(rule_id).alias("rule_id"), F.lit(name).alias("rule_name"), F.lit(hard).alias("hard"), verdict.alias("verdict"), text(because).alias("because"), text(derived).alias("derived"), facts.alias("evidence"), texts(citations).alias("citations"), texts(assumptions).alias("assumptions"))


def _chain(*steps: tuple[Column, str], other: str = PASS) -> Column:
    """First condition that is true decides; a null condition is not true."""
    out = F
    for condition, verdict in steps:
        out = out.when(F.coalesce(condition, F.lit(False)), verdict)
    return out.otherwise(other)


def touches(origin: Column, destination: Column, places: Sequence[str]) -> Column:
    """FLT-04."""
    return F.coalesce(origin.isin(*places), F.lit(False)) | F.coalesce(destination.isin(*places), F.lit(False))


def in_season(at: Column, months: Sequence[int]) -> Column:
    """FLT-05."""
    return F.coalesce(F.month(at).isin(*months), F.lit(False))


def availability(candidate: Column, failed: Column, status: Column, active: str = "Active") -> Column:
    """RULE-000; a null status passes."""
    return _chain((candidate == failed, FAIL), (status.isNotNull() & (status != active), FAIL))


def required_value(applies: Column, value: Column, wanted: str) -> Column:
    """RULE-001: where it applies, a value must be the wanted one."""
    return _chain((~applies, NOT_APPLICABLE), (value.isNull(), INSUFFICIENT), (value == wanted, PASS), other=FAIL)


def required_flag(applies: Column, flag: Column) -> Column:
    """RULE-002."""
    return _chain((~applies, NOT_APPLICABLE), (flag.isNull(), INSUFFICIENT), (flag, PASS), other=FAIL)


def cooled_off(applies: Column, last: Column, at: Column, days: int) -> Column:
    """RULE-003: nothing of the kind within so many days."""
    return _chain((~applies, NOT_APPLICABLE), (last.isNull(), PASS), (days_between(last, at) > days, PASS), other=FAIL)


def service_window(client: Column, named: str, rule_hours: int, client_hours: Column) -> tuple[Column, Column]:
    """RULE-004: verdict, and the hours that hold: the rule's for its client, else the client's own."""
    return _chain((client == named, PASS), other=NOT_APPLICABLE), F.when(client == named, F.lit(rule_hours)).otherwise(client_hours)


def gate_hours(client: Column, named: str, destination: Column, site: str, at: Column, opens: int, closes: int) -> Column:
    """RULE-005."""
    return _chain((~F.coalesce(client == named, F.lit(False)), NOT_APPLICABLE), (~F.coalesce(destination == site, F.lit(False)), NOT_APPLICABLE), (~in_hours(F.hour(at), opens, closes), FAIL))


def rotation(client: Column, named: str, prior: Column) -> Column:
    """RULE-006: no earlier incident of this vehicle with that client."""
    return _chain((~F.coalesce(client == named, F.lit(False)), NOT_APPLICABLE), (F.coalesce(prior, F.lit(0)) > 0, FAIL))


def least_year(client: Column, named: str, year: Column, least: int) -> Column:
    """RULE-007."""
    return _chain((~F.coalesce(client == named, F.lit(False)), NOT_APPLICABLE), (year.isNull(), INSUFFICIENT), (year >= least, PASS), other=FAIL)


def no_overnight(client: Column, named: str, at: Column, start: int = 20, stop: int = 6) -> Column:
    """RULE-008."""
    return _chain((~F.coalesce(client == named, F.lit(False)), NOT_APPLICABLE), (in_hours(F.hour(at), start, stop), FAIL))


def seasonal_padding(applies: Column, hours: Column, percent: float) -> tuple[Column, Column]:
    """RULE-009: FAIL says that padding is due; quoted hours."""
    return _chain((applies, FAIL), other=NOT_APPLICABLE), F.when(applies, padded_hours(hours, percent)).otherwise(hours)


def sourcing(km: Column, origin: Column, ordered: Column, limit_km: float = 50) -> tuple[Column, Column]:
    """RULE-010: (hubs in order, whether only the origin counts)."""
    near = F.coalesce(km <= limit_km, F.lit(False))
    return F.when(near, F.array(origin)).otherwise(F.concat(F.array(origin), F.coalesce(ordered, F.array().cast("array<string>")))), near


def overdue_service(last_visit: Column, at: Column, interval: int = 180, grace: int = 30, margin: int = 15) -> tuple[Column, Column]:
    """RULE-011: verdict, and whether it is within margin days of grounding."""
    overdue = days_between(last_visit, at) - interval
    return _chain((last_visit.isNull(), INSUFFICIENT), (overdue > grace, FAIL)), F.coalesce((overdue <= grace) & (grace - overdue <= margin), F.lit(False))


def leaves_region(home: Column, destination: Column) -> Column:
    """JOIN-16: whether two regions are known to differ; an unknown one never does."""
    return F.coalesce(home != destination, F.lit(False))


def temporary_fix(open_since: Column, at: Column, home_region: Column, destination_region: Column, days: int = 7) -> Column:
    """RULE-012: an open temporary fix lasts so many days, and only within the home region."""
    return _chain((open_since.isNull(), PASS), (F.coalesce(days_between(open_since, at), F.lit(days + 1)) > days, FAIL), (leaves_region(home_region, destination_region), FAIL))


def night_driver(driver: Column, joined: Column, at: Column, as_of: Column, start: int = 21, stop: int = 5, months: int = 6) -> Column:
    """RULE-013."""
    return _chain((driver.isNull(), INSUFFICIENT), (~in_hours(F.hour(at), start, stop), NOT_APPLICABLE), (joined.isNull(), INSUFFICIENT), (months_between(joined, as_of) >= months, PASS), other=FAIL)


def evaluate(checks: Sequence[Column] | Column) -> dict[str, Column]:
    """EVAL-01: checks, the ids that block, the ids that lack data, eligible, caveats_only, derived ids."""
    all_ = checks if isinstance(checks, Column) else F.array(*checks)
    ids = lambda verdict: F.transform(F.filter(all_, lambda c: c["hard"] & (c["verdict"] == verdict)), lambda c: c["rule_id"])
    blocking, unknown = ids(FAIL), ids(INSUFFICIENT)
    return {
        "checks": all_, "blocking": blocking, "unknown": unknown,
        "eligible": (F.size(blocking) == 0) & (F.size(unknown) == 0), "caveats_only": (F.size(blocking) == 0) & (F.size(unknown) > 0),
        "derived": F.transform(F.filter(all_, lambda c: c["derived"] & (c["verdict"] != NOT_APPLICABLE)), lambda c: c["rule_id"]),
    }
