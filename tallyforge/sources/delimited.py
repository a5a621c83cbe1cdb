"""Delimited text with quotes anywhere in a field, ragged rows and an unknown delimiter."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.core import let

DELIMITERS = (",", ";", "\t", "|")


def sniff(text: str) -> str:
    """SRC-03: the commonest delimiter of the first line; of equal ones the earlier in the list; a comma if there is none."""
    line = text.split("\n", 1)[0]
    return max(DELIMITERS, key=lambda d: (line.count(d), -DELIMITERS.index(d)))


def sniff_column(line: Column) -> Column:
    """SRC-03 on a column of first lines."""
    counts = [F.struct((F.length(line) - F.length(F.replace(line, F.lit(d), F.lit("")))).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)]
    return F.array_max(F.array(*counts))["d"]


def parse_rows(text: str, delimiter: str = ",") -> Iterator[list[str]]:
    """SRC-01: rows of cells. A quote toggles wherever it stands, a doubled one inside quotes is a quote; carriage returns outside quotes and a byte order mark go."""
    row: list[str] = []
    cell: list[str] = []
    quoted, i, text = False, 0, text.removeprefix("﻿")
    while i < len(text):
        ch = text[i]
        if ch == '"':
            if quoted and text[i + 1 : i + 2] == '"':
                cell.append('"')
                i += 1
            else:
                quoted = not quoted
        elif quoted or ch not in (delimiter, "\n", "\r"):
            cell.append(ch)
        elif ch != "\r":
            row.append("".join(cell))
            cell = []
            if ch == "\n":
                yield row
                row = []
        i += 1
    if cell or row:
        yield [*row, "".join(cell)]


def parse_records(text: str, source: str, delimiter: str = ",") -> list[dict]:
    """SRC-02: trimmed cells by header; missing ones '', further ones in _extra; rows of one blank cell are skipped; _row counts records from 2."""
    rows = parse_rows(text, delimiter)
    header = [h.strip() for h in next(rows, [])]
    out = []
    for n, row in enumerate((r for r in rows if len(r) > 1 or (r and r[0].strip())), 2):
        record = {h: (row[i].strip() if i < len(row) else "") for i, h in enumerate(header)}
        if len(row) > len(header):
            record["_extra"] = row[len(header) :]
        out.append(record | {"_row": n, "_source": source})
    return out


def strip(x: Column) -> Column:
    """x without white space of any kind and byte order marks at its ends."""
    return F.regexp_replace(x, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def _plain(cell: Column) -> Column:
    """A cell without the quotes that open and close: text between two quotes stays, an empty stretch between two pairs of them is a quote, carriage returns elsewhere go."""
    bare = F.replace(cell, F.lit("\r"), F.lit(""))
    piece = lambda parts: lambda x, i: F.when(i % 2 == 1, x).when((x == "") & (i > 0) & (i < F.size(parts) - 1), '"').otherwise(F.replace(x, F.lit("\r"), F.lit("")))
    return F.when(~cell.contains('"'), bare).otherwise(let(F.split(cell, '"', -1), lambda parts: F.array_join(F.transform(parts, piece(parts)), "")))


def rows_of(text: Column | str, delimiter: Column | str = ",") -> Column:
    """SRC-01 as a column: rows of cells, by the rules of parse_rows. delimiter: one character, or a column of them.

    Matched with possessive patterns, which neither go back nor nest, so a text of any length takes time in proportion to it. Null text gives null, an empty one no rows.
    """
    x = F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"^\x{FEFF}", "")
    d = F.concat(F.lit(r"\Q"), F.lit(delimiter) if isinstance(delimiter, str) else delimiter, F.lit(r"\E"))
    quoted = r'"(?:[^"]++|"")*+(?:"|\z)'
    # each match begins with the line feed or delimiter before it, so none is empty
    records = F.regexp_extract_all(F.concat(F.lit("\n"), x), F.lit(rf'\n((?:[^"\n]++|{quoted})*+)'), F.lit(1))
    cell = F.concat(d, F.lit('((?:[^"\n'), d, F.lit(f"]++|{quoted})*+)"))
    first = F.lit(delimiter) if isinstance(delimiter, str) else delimiter
    rows = F.transform(records, lambda r: F.transform(F.regexp_extract_all(F.concat(first, r), cell, F.lit(1)), _plain))
    blank = lambda r: (F.size(r) == 1) & (F.get(r, F.lit(0)) == "")
    # what follows the last line feed is a row only if there is something in it
    return let(rows, lambda all_: F.when(blank(F.element_at(all_, -1)), F.slice(all_, 1, F.size(all_) - 1)).otherwise(all_))


def _blank(row: Column) -> Column:
    return (F.size(row) <= 1) & (strip(F.get(row, F.lit(0))) == "")


def json_records(text: Column | str, delimiter: Column | str) -> Column:
    """SRC-02 as a column of JSON objects, a text's records: cells by header, missing ones empty; further ones and fields that begin with an underscore are left out; of fields of one name the last counts."""

    def record(head: Column, row: Column) -> Column:
        cells = F.transform(head, lambda h, i: F.struct(h.alias("key"), F.coalesce(strip(F.get(row, i)), F.lit("")).alias("value")))
        last = F.filter(cells, lambda e, i: ~e["key"].startswith("_") & ~F.array_contains(F.slice(head, i + 2, F.size(head)), e["key"]))
        return F.to_json(F.map_from_entries(last))

    body = lambda rows: F.filter(F.slice(rows, 2, F.size(rows)), lambda r: ~_blank(r))
    with_head = lambda rows, head: F.transform(body(rows), lambda r: record(head, r))
    return let(rows_of(text, delimiter), lambda rows: let(F.transform(F.get(rows, F.lit(0)), strip), lambda head: with_head(rows, head)))


def records_of(texts: DataFrame, columns: Sequence[str], delimiter: Column | str = ",", text: str = "value") -> DataFrame:
    """SRC-02 on texts with a header each: their other columns, then the named columns, _row and _extra; a row a record.

    Cells are trimmed; a column that the header lacks is null, a cell that a row lacks is empty; of columns of one name the last counts; what a row has beyond the header is in
    _extra, else null. Rows of one blank cell are left out; _row counts the others from 2. Texts without rows, and null ones, give none.
    """
    others = [F.col(f"`{c}`") for c in texts.columns if c != text]
    parsed = texts.select(*others, rows_of(text, delimiter).alias("__rows"))
    head = F.transform(F.get("__rows", F.lit(0)), strip)
    body = F.filter(F.slice("__rows", 2, F.greatest(F.size("__rows"), F.lit(0))), lambda r: ~_blank(r))
    names = [F.col(f"`{c}`") for c in texts.columns if c != text]
    each = parsed.select(*names, F.reverse(head).alias("__head"), F.posexplode_outer(body).alias("__at", "__cells")).filter("__at is not null")  # outer: texts are not parsed once more, to test that there are records
    place = lambda c: F.size("__head") - F.array_position("__head", c)
    cell = lambda c: F.when(F.array_contains("__head", c), F.coalesce(strip(F.get("__cells", place(c).cast("int"))), F.lit("")))
    extra = F.when(F.size("__cells") > F.size("__head"), F.slice("__cells", F.size("__head") + 1, F.size("__cells")))
    return each.select(*names, *(cell(c).alias(c) for c in columns), (F.col("__at") + 2).cast("bigint").alias("_row"), extra.alias("_extra"))


def read_irregular(spark: SparkSession, path: str, columns: Sequence[str], delimiter: str | None = None) -> DataFrame:
    """Files that need the exact tokenizer, each one text: columns, _row, _source, _extra. Without a delimiter each file's first line tells. Regular files: spark.read.csv."""
    texts = spark.read.text(path, wholetext=True).select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("_source"))
    sep = F.lit(delimiter) if delimiter else sniff_column(F.substring_index("value", "\n", 1))
    return records_of(texts, columns, sep).select(*(F.col(f"`{c}`") for c in columns), "_row", "_source", "_extra")
