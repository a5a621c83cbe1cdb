"""Selection of the best candidate by group over ordered sources, with tallies and escalations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def pick(candidates: DataFrame, group: Sequence[str], usable: Column, order: Sequence[Column], carry: Sequence[str] | None = None) -> DataFrame:
    """SEL-01, WIN-05: the first usable candidate of each group, by a struct of keys that all rise; one aggregation, with partial minima before the shuffle and no window.

    The keys should tell all candidates of a group apart. carry: the columns to keep, all by default.
    """
    kept = [c for c in (carry if carry is not None else candidates.columns) if c not in group]
    keys = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)))
    best = candidates.filter(usable).groupBy(*group).agg(F.min_by(F.struct(*kept), keys).alias("__best"))
    return best.select(*group, *(F.col(f"__best.{c}").alias(c) for c in kept))


def ranking(eligible: Column, derived: Column, newest_first: Column, n_events: Column, year: Column, key: Column) -> list[Column]:
    """SEL-02: six keys that all rise: eligible first, then what rests on no assumption, for some clients the newer, what has a history, the newer, the key; a null year is 0."""
    newer = -F.coalesce(year, F.lit(0))
    return [(~eligible).cast("int"), derived.cast("int"), F.when(newest_first, newer).otherwise(0), (F.coalesce(n_events, F.lit(0)) == 0).cast("int"), newer, key]


#: Bits of a packed rank for each of the six keys, the first being the highest; vehicles are numbered in the order of their keys.
BITS = (1, 1, 16, 1, 16, 28)


def packed(eligible: Column, derived: Column, newest_first: Column, n_events: Column, year: Column, number: Column) -> Column:
    """SEL-02: the six keys as one number of 63 bits, in the same order as ranking() for years from 0 to 65,535.

    A minimum of a number needs no sorting, so candidates are reduced by a hash aggregate as they are made; a struct would be sorted first.
    """
    older = F.lit(65_535) - F.least(F.greatest(F.coalesce(year, F.lit(0)), F.lit(0)), F.lit(65_535))
    out = F.lit(0).cast("bigint")
    for key, bits in zip([(~eligible).cast("int"), derived.cast("int"), F.when(newest_first, older).otherwise(0), (F.coalesce(n_events, F.lit(0)) == 0).cast("int"), older, number], BITS, strict=True):
        out = F.shiftleft(out, bits).bitwiseOR(key.cast("bigint"))
    return out


def unpacked(rank: Column) -> dict[str, Column]:
    """What a packed rank says of its candidate: eligible, derived, number."""
    bit = lambda place: F.shiftright(rank, place).bitwiseAND(F.lit(1).cast("bigint"))
    top = sum(BITS)
    return {"eligible": bit(top - 1) == 0, "derived": bit(top - 2) == 1, "number": rank.bitwiseAND(F.lit((1 << BITS[-1]) - 1))}


def tally(candidates: DataFrame, by: Sequence[str], eligible: Column, caveats: Column) -> DataFrame:
    """AGG-09."""
    return candidates.groupBy(*by).agg(F.count("*").alias("considered"), F.count_if(eligible).alias("n_eligible"), F.count_if(caveats).alias("n_caveats"), F.count_if(~eligible & ~caveats).alias("n_rejected"))


def reasons(candidates: DataFrame, group: Sequence[str], codes: Column) -> DataFrame:
    """AGG-10, SRT-04: how often each code rejects, commonest first."""
    return candidates.select(*group, F.explode(codes).alias("code")).groupBy(*group, "code").agg(F.count("*").alias("n")).orderBy(*group, F.desc("n"), "code")


def escalations(requests: DataFrame, picked: DataFrame, group: Sequence[str]) -> DataFrame:
    """SEL-03: requests for which nothing was picked."""
    return requests.join(picked.select(*group), list(group), "left_anti")
