"""CTX-01 whole: registers, trips, mails and names into the tables that decisions are made against and a snapshot shows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.core import months_between, subject_tokens
from tallyforge.operators import dedup, resolve
from tallyforge.scratch import settle
from tallyforge.sources import names as people

from .decision import Context, Rulebook, build_context


@dataclass
class FullContext:
    """What a run knows before it sees a ticket."""

    core: Context
    merged: DataFrame  # the core's vehicles with trips
    drivers: DataFrame  # with tenure_months at as_of
    differing: DataFrame  # conflicts among the registers
    names: DataFrame  # name; never leaves the run
    as_of: str
    sources: dict[str, DataFrame]  # maintenance, trips and mails

    # worked out when first asked for: who wants drivers does not sort the log

    @cached_property
    def fallen(self) -> DataFrame:
        """Vehicles whose odometer falls, with the falls."""
        back = resolve.regressions(self.sources["maintenance"], "reg_key", ["date", "citation"], "odometer_km")
        return settle(back.groupBy("reg_key").agg(F.count("*").alias("n_values"), F.array_join(F.array_sort(F.collect_set(F.concat_ws(">", F.col("previous").cast("string"), F.col("odometer_km").cast("string")))), "|").alias("values")))

    @cached_property
    def vehicles(self) -> DataFrame:
        """The core's vehicles with trips and odometer_trusted."""
        return self.merged.join(self.fallen.select("reg_key", F.lit(False).alias("odometer_trusted")), "reg_key", "left").fillna({"odometer_trusted": True})

    @cached_property
    def claims(self) -> DataFrame:
        """claim_key, subject, files, n_threads, n_variants."""
        return claims_of(self.sources["mails"])

    @cached_property
    def conflicts(self) -> DataFrame:
        """reg_key, field, n_values, values."""
        odd = self.fallen.join(self.core.vehicles.select("reg_key"), "reg_key").select("reg_key", F.lit("odometer_km").alias("field"), "n_values", "values")
        return self.differing.unionByName(odd)

    @cached_property
    def orphans(self) -> dict[str, int]:
        """Rows of a source that no vehicle owns."""
        return {name: self.sources[name].join(self.core.vehicles.select("reg_key"), "reg_key", "left_anti").count() for name in ("maintenance", "trips")}

    def snapshot(self) -> dict[str, tuple[DataFrame, str]]:
        """SNK-05: the tables that may be written, each with the key it is ordered by."""
        return {"vehicles": (self.vehicles, "reg_key"), "drivers": (self.drivers, "driver_id"), "email_claims": (self.claims, "claim_key"), "conflicts": (self.conflicts, "reg_key")}


def trip_rollup(trips: DataFrame) -> DataFrame:
    """AGG-06, JOIN-02: a row a vehicle: total, cancelled, first and last dispatch (as text), and trips by client. Counts are summed by vehicle and client first, so a vehicle with most trips is as many rows as it has clients."""
    text = F.coalesce(F.col("dispatch_time").cast("string"), F.lit(""))
    small = trips.filter("reg_key is not null").groupBy("reg_key", "client").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "CANCELLED").alias("cancelled"), F.min(text).alias("first"), F.max(text).alias("last"))
    by = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("client").isNotNull(), F.struct("client", "n")))))
    return small.groupBy("reg_key").agg(F.sum("n").alias("total"), F.sum("cancelled").alias("cancelled"), F.min("first").alias("first"), F.max("last").alias("last"), by.alias("by_client"))


def claims_of(mails: DataFrame, threshold: float = 0.85) -> DataFrame:
    """DUP-02: a row a claim: mails of one subject whose bodies are equal or near each other, led by the first file; n_variants is how many different texts it has.

    Equal mails are one row before anything is compared, and subjects never mix, as the same few words under another subject are another matter.
    """
    same = settle(mails.groupBy("subject", "claim_key").agg(F.min("file").alias("id"), F.array_sort(F.collect_list("file")).alias("files"), F.first("body").alias("body")))
    clusters = dedup.near_clusters(same.select("subject", "id", subject_tokens("body").alias("tokens")), "subject", "id", "tokens", threshold)
    led = clusters.join(same.select("id", "subject", "claim_key", "files"), "id")
    return led.groupBy("leader").agg(F.min_by("claim_key", "id").alias("claim_key"), F.min("subject").alias("subject"), F.array_sort(F.flatten(F.collect_list("files"))).alias("files"), F.count("*").alias("n_variants")).select("claim_key", "subject", "files", F.size("files").cast("bigint").alias("n_threads"), "n_variants")


def latest_date(maintenance: DataFrame, mails: DataFrame) -> str | None:
    """AGG-22: the latest date of the log and of the mails' date lines, as YYYY-MM-DD."""
    said = mails.select(F.explode("dates").alias("said")).select(F.coalesce(F.to_date(F.try_to_timestamp("said", F.lit("d MMM yyyy"))), F.to_date(F.try_to_timestamp("said", F.lit("yyyy-MM-dd")))).alias("day"))
    return maintenance.select(F.to_date("date").alias("day")).unionByName(said).agg(F.date_format(F.max("day"), "yyyy-MM-dd")).first()[0]


def build_full(fleet: DataFrame, maintenance: DataFrame, trips: DataFrame, drivers: DataFrame, distances: DataFrame, mails: DataFrame, rulebook: Rulebook, names: Sequence[DataFrame] = (), places: DataFrame | None = None, as_of: str | None = None) -> FullContext:
    """CTX-01: merged vehicles with workshop history, trips and whether their odometer can be trusted; drivers with their tenure; claims; conflicts; names.

    as_of: the day that tenures are told at; without it the latest date in the log and mails, never the clock, so runs repeat.
    """
    core, differing = build_context(fleet, maintenance, distances, drivers, rulebook, places)
    rollup = trip_rollup(trips)
    none = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("cancelled"), F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("last"), F.create_map().cast("map<string, bigint>").alias("by_client"))
    travelled = rollup.select("reg_key", F.struct("total", "cancelled", "first", "last", "by_client").alias("trips"))
    vehicles = core.vehicles.join(travelled, "reg_key", "left").withColumn("trips", F.coalesce("trips", none))
    day = as_of or latest_date(maintenance, mails)
    tenure = months_between(F.col("joining_date"), F.lit(day).cast("date"))
    found = people.collect_names(names) if names else fleet.sparkSession.createDataFrame([], "name string")
    return FullContext(core, vehicles, drivers.withColumn("tenure_months", tenure), differing, found, day, {"maintenance": maintenance, "trips": trips, "mails": mails})
