"""Ticket files of unknown shape: container detection, alias mapping, typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.core import blank_to_null, kilometres, let, norm_key, severity

from .delimited import json_records, sniff_column, strip

# Keys under which an object can hold the list of tickets.
WRAPPERS = ("tickets", "data", "items", "records", "queue", "rows", "results", "payload", "entries")
# Accepted spellings of the fields, without case and separators.
ALIASES = {
    "ticket_id": "ticketid id ticketno ticketnumber ticketref reference refno caseid incidentid",
    "created_at": "createdat created createdon timestamp time datetime date reportedat raisedat openedat eventtime whenraised raisedon loggedat occurredat incidentat when",
    "vehicle": "vehicle vehiclereg vehicleregistration registration registrationnumber reg regno truck truckno plate platenumber vehicleno vehiclenumber",
    "driver_id": "driverid driver driverref drivercode drivernumber",
    "origin_hub": "originhub origin source sourcehub fromhub from startinghub basehub hub",
    "km_from_origin_hub": "kmfromoriginhub kmfromorigin distancefromoriginkm distancefromorigin distancekm km kms distance breakdownkm kmfromhub",
    "destination": "destination dest desthub destinationhub to tohub deliverylocation droplocation",
    "issue": "issue problem fault description issuetype breakdowntype symptom complaint",
    "severity": "severity priority urgency criticality sev",
    "client": "client customer account clientname customername consignor",
    "status": "status state ticketstatus currentstatus",
    "resolution_note": "resolutionnote resolution notes note remarks comment comments closurenote",
}


#: JSON as the standard has it.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
TEXTS, LIST = "map<string,string>", "array<string>"


def _kind(parsed: Column, text: Column) -> Column:
    """O for an object, A for a list, S for a string, other letters for the rest; by its first character where no variant could be made (an object that repeats a name)."""
    return F.coalesce(F.substring(F.schema_of_variant(parsed), 1, 1), F.when(text.startswith("{"), "O").when(text.startswith("["), "A"), F.lit("?"))


def _fields(text: Column) -> Column:
    """Fields (key, value, kind) of a JSON object in order; values as strings, nested ones as JSON."""
    variants = F.map_values(F.from_json(text, "map<string,variant>", STRICT))
    return let(variants, lambda v: F.transform(F.map_entries(F.from_json(text, TEXTS, STRICT)), lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), _kind(F.get(v, i), e["value"]).alias("kind"))))


def _elements(text: Column) -> Column:
    """Elements (raw, kind) of a JSON list: each one's JSON."""
    quoted = lambda x: let(F.to_json(F.array(x)), lambda a: F.substring(a, F.lit(2), F.length(a) - 2))
    one = lambda x, kind: F.struct(F.when(x.isNull(), "null").when(kind == "S", quoted(x)).otherwise(x).alias("raw"), kind.alias("kind"))
    return let(F.from_json(text, "array<variant>", STRICT), lambda v: F.transform(F.from_json(text, LIST, STRICT), lambda x, i: one(x, _kind(F.get(v, i), x))))


def _whole(text: Column) -> Column:
    """A text that is one JSON value and nothing more, rewritten without needless space; else null. Parsers stop where a value ends, so it must stand as the only element of a list and as a field before another."""
    alone, before = F.from_json(F.concat(F.lit("["), text, F.lit("]")), LIST, STRICT), F.from_json(F.concat(F.lit('{"x":'), text, F.lit(',"y":0}')), TEXTS, STRICT)
    return F.when((F.size(alone) == 1) & (F.size(before) == 2), F.when(text.rlike(r"^[\[{]"), F.get(alone, F.lit(0))).otherwise(text))


def containers(texts: DataFrame) -> DataFrame:
    """SRC-06: texts (name, value) with their format and records (raw, kind): list, object, JSON lines and delimited text are tried in that order.

    A list that is not valid JSON holds the bad line 1; of JSON lines those that are not valid are records {"_bad_line": n} after the others, n counting lines that are not blank.
    Delimited records leave out fields that begin with an underscore; of those of one name the last counts. Empty texts are unknown and hold nothing, null ones like them.
    """
    body = strip(F.coalesce("value", F.lit("")))
    step = texts.withColumns({"__body": body, "__ext": F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))})
    starts = F.substring("__body", 1, 1)
    step = step.withColumn("__whole", F.when(starts.isin("[", "{"), _whole(F.col("__body"))))
    is_object, is_whole = starts == "{", F.col("__whole").isNotNull()
    step = step.withColumns({
        "__fields": F.when(is_object & is_whole, _fields(F.col("__whole"))),
        "__lines": F.when(is_object & ~is_whole, F.transform(F.filter(F.split("__body", "\r?\n"), lambda x: strip(x) != ""), lambda x, i: F.struct((i + 1).alias("n"), _whole(strip(x)).alias("raw")))),
    })
    held = lambda key: F.try_element_at(F.filter("__fields", lambda e: e["key"] == key), F.lit(-1))
    step = step.withColumns({
        "__wrapper": F.get(F.filter(F.array(*map(F.lit, WRAPPERS)), lambda w: held(w)["kind"] == "A"), F.lit(0)),
        "__good": F.filter("__lines", lambda x: x["raw"].isNotNull()),
        "__bad": F.transform(F.filter("__lines", lambda x: x["raw"].isNull()), lambda x: x["n"]),
    })
    line = F.substring_index("__body", "\n", 1)
    delimited_ = ~starts.isin("[", "{") & (F.col("__ext").isin("csv", "tsv", "txt") | line.rlike(r"[,;\t|]"))
    step = step.withColumn("__sep", F.when(delimited_, F.when(F.col("__ext") == "tsv", "\t").otherwise(sniff_column(line))))
    labels = F.create_map(*(F.lit(x) for kv in {",": "csv", ";": "csv_semicolon", "\t": "tsv", "|": "psv"}.items() for x in kv))
    form = F.when(starts == "[", "json_array").when(F.col("__wrapper").isNotNull(), F.concat(F.lit("json_object."), "__wrapper")).when(is_object & is_whole, "json_single_object")
    form = form.when(F.size("__good") > 0, "jsonl").when(F.col("__sep").isNotNull(), F.try_element_at(labels, "__sep")).otherwise("unknown")
    bad = F.transform(F.when(is_object, F.col("__bad")).when((starts == "[") & ~is_whole, F.array(F.lit(1))), lambda n: F.struct(F.concat(F.lit('{"_bad_line":'), n, F.lit("}")).alias("raw"), F.lit("O").alias("kind")))
    lines = F.transform("__good", lambda x: F.struct(x["raw"].alias("raw"), F.when(x["raw"].startswith("{"), "O").otherwise("?").alias("kind")))
    rows = F.transform(F.when(F.col("__sep").isNotNull(), json_records("value", F.col("__sep"))), lambda r: F.struct(r.alias("raw"), F.lit("O").alias("kind")))
    none = F.array().cast("array<struct<raw:string,kind:string>>")
    records = F.when(starts == "[", _elements(F.col("__whole"))).when(F.col("__wrapper").isNotNull(), _elements(held(F.col("__wrapper"))["value"]))
    records = records.when(is_object & is_whole, F.array(F.struct(F.col("__whole").alias("raw"), F.lit("O").alias("kind")))).when(is_object, lines).otherwise(rows)
    return step.select(*texts.columns, form.alias("format"), F.concat(F.coalesce(records, none), F.coalesce(bad, none)).alias("records"))


def flatten(raw: Column | str) -> Column:
    """PRJ-06: entries (key, value) of a JSON object, nested objects to two levels named by path.

    After a nested object its leaves come by bare name too. A name stands where it first came up; a field by its own name or path counts before a bare one, and the last of those; of bare ones the first.
    """

    def entry(key: Column, value: Column, bare: bool) -> Column:
        return F.struct(key.alias("key"), value.alias("value"), F.lit(bare).alias("bare"))

    def expand(text: Column, prefix: Column | None, depth: int) -> Column:
        name = lambda e: e["key"] if prefix is None else F.concat(prefix, F.lit("_"), e["key"])
        own = lambda e: entry(name(e), e["value"], False)
        if depth == 2:
            return F.transform(_fields(text), own)
        leaves = lambda e: F.transform(F.filter(_fields(e["value"]), lambda y: ~y["kind"].isin("O", "A")), lambda y: entry(y["key"], y["value"], True))
        return F.flatten(F.transform(_fields(text), lambda e: F.when(e["kind"] == "O", F.concat(expand(e["value"], name(e), depth + 1), leaves(e))).otherwise(F.array(own(e)))))

    counts = lambda of: F.coalesce(F.try_element_at(F.filter(of, lambda x: ~x["bare"]), F.lit(-1)), F.get(of, F.lit(0)))
    kept = lambda all_, k: F.struct(k.alias("key"), let(F.filter(all_, lambda x: x["key"] == k), counts)["value"].alias("value"))
    return let(expand(F.col(raw) if isinstance(raw, str) else raw, None, 0), lambda all_: F.transform(F.array_distinct(F.transform(all_, lambda x: x["key"])), lambda k: kept(all_, k)))


def raw_tickets(texts: DataFrame) -> DataFrame:
    """(file, format, idx, raw, entries) of rows (name, value): one row a record, bad lines too; entries keep the record's field order and are empty where a record is no object."""
    each = containers(texts.select("name", "value")).select(F.col("name").alias("file"), "format", F.posexplode_outer("records").alias("idx", "r")).filter("idx is not null")  # without outer, Spark would work the records out a second time, to test that there are some
    entries = F.when(F.col("r.kind") == "O", flatten("r.raw"))
    return each.select("file", "format", F.col("idx").cast("bigint").alias("idx"), "r.raw", F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>")).alias("entries"))


def _named(entries: Column | str, aliases: dict[str, str]) -> Column:
    """Entries (name, key, value) that do not begin with an underscore; name: the field that the key spells, else null. Keys are normalised once, however many fields are asked for."""
    known = {spelling: k for k, v in reversed(aliases.items()) for spelling in (*v.split(), k.replace("_", ""))}
    names = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    shown = F.filter(entries, lambda e: ~e["key"].startswith("_"))
    return F.transform(shown, lambda e: F.struct(F.try_element_at(names, norm_key(e["key"])).alias("name"), e["key"].alias("key"), e["value"].alias("value")))


def _first(named: Column | str, name: str) -> Column:
    return F.trim(F.get(F.filter(named, lambda e: (e["name"] == name) & (e["value"] != "")), F.lit(0))["value"])


def field(entries: Column | str, name: str, aliases: dict[str, str] = ALIASES) -> Column:
    """PRJ-05, WIN-08: the first value, in the record's order, under any accepted spelling, that is not empty."""
    return _first(_named(entries, {name: aliases[name]}), name)


def read_tickets(spark: SparkSession, path: str) -> DataFrame:
    """SRC-07: typed tickets with provenance and the names of fields that no spelling covers."""
    return tickets_of(spark.read.text(path, wholetext=True).select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name")))


def tickets_of(texts: DataFrame) -> DataFrame:
    """SRC-07 on rows (name, value), a file each."""
    named = raw_tickets(texts).withColumn("__named", _named("entries", ALIASES)).drop("entries")
    unmapped = F.array_sort(F.array_distinct(F.transform(F.filter("__named", lambda e: e["name"].isNull()), lambda e: e["key"])))
    citation = F.concat(F.col("file"), F.lit("#record"), F.col("idx") + 1)
    plain = named.select("file", "format", "idx", "raw", *(_first("__named", k).alias(k) for k in ALIASES), unmapped.alias("unmapped"), citation.alias("citation"))
    typed = {"severity": severity("severity"), "km_from_origin_hub": kilometres("km_from_origin_hub")}
    return plain.withColumns({k: blank_to_null(k) for k in ALIASES}).withColumns(typed)
