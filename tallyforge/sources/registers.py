"""The four registers: vehicles, drivers, workshop visits and trips, from records of texts.

Every function takes a table of string columns with _row and _source and gives (rows, alerts): typed rows with a citation, and an alert
(code, file, row) for each record that lacks its key. Personal fields leave as keyed pseudonyms or not at all.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.core import blank_to_null, cite, note_flags, pseudonym, redacted_text, reg_key


def _number(name: str) -> Column:
    return F.col(name).try_cast("double")


def _scan(rows: DataFrame, key: Column, code: str, columns: list[Column]) -> tuple[DataFrame, DataFrame]:
    known = F.coalesce(key != "", F.lit(False))
    kept = rows.filter(known).select(*columns, cite("_source", F.concat(F.lit("row"), F.col("_row"))).alias("citation"))
    return kept, rows.filter(~known).select(F.lit(code).alias("code"), F.col("_source").alias("file"), F.col("_row").alias("row"))


def fleet(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-08: registration_number, vehicle_id, model, year, bs_stage, engine_heater, home_hub, capacity_tonnes, status. A heater is yes from a y on; blank is unknown."""
    key = reg_key("registration_number")
    text = [blank_to_null(c).alias(c) for c in ("vehicle_id", "model", "bs_stage", "home_hub", "status")]
    heater = F.when(blank_to_null("engine_heater").isNotNull(), F.col("engine_heater").rlike("^[yY]")).alias("engine_heater")
    return _scan(rows, key, "FLEET_ROW_NO_REGISTRATION", [key.alias("reg_key"), *text, _number("year").cast("int").alias("year"), heater, _number("capacity_tonnes").alias("capacity_tonnes")])


def drivers(rows: DataFrame, secret: bytes) -> tuple[DataFrame, DataFrame]:
    """SRC-09: driver_id, name, joining_date, home_hub; the name leaves as a pseudonym, other personal columns are not read."""
    return _scan(rows, F.col("driver_id"), "DRIVER_ROW_NO_ID", [F.col("driver_id"), pseudonym("name", "PERSON", secret).alias("person_ref"), blank_to_null("joining_date").try_cast("date").alias("joining_date"), blank_to_null("home_hub").alias("home_hub")])


def maintenance(rows: DataFrame, secret: bytes, names: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """SRC-10: vehicle, date, odometer_km, mechanic, notes: key, masked note, five flags of the note, the mechanic's pseudonym."""
    key = reg_key("vehicle")
    flags = [v.alias(k) for k, v in note_flags("notes").items()]
    return _scan(rows, key, "MAINTENANCE_ROW_NO_VEHICLE", [key.alias("reg_key"), blank_to_null("date").try_cast("date").alias("date"), _number("odometer_km").alias("odometer_km"), pseudonym("mechanic", "MECHANIC", secret).alias("mechanic_ref"), redacted_text("notes", names=names).alias("notes"), *flags])


def trips(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-11: rows without trip_id go; an unknown vehicle stays as null."""
    text = [blank_to_null(c).alias(c) for c in ("driver_id", "client", "status", "route_type", "dispatch_time", "delivery_time", "origin_name", "dest_name")]
    numbers = [_number(c).alias(c) for c in ("osrm_time_min", "actual_time_min", "osrm_distance_km")]
    return _scan(rows, F.col("trip_id"), "TRIP_ROW_NO_ID", [F.col("trip_id"), blank_to_null(reg_key("vehicle_reg")).alias("reg_key"), *text, *numbers])
