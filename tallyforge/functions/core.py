"""Column functions: keys, coercions, dates, hashing, privacy. All are JVM-side expressions."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings of severities.
SEVERITIES = {
    "HIGH": ("HIGH", "H", "CRITICAL", "P1", "URGENT", "1", "3"),
    "MEDIUM": ("MEDIUM", "MED", "M", "P2", "NORMAL", "2"),
    "LOW": ("LOW", "L", "P3", "MINOR", "0"),
}
# Workshop note markers by flag.
NOTE_MARKERS = {
    "jugaad": r"jugaad|temporary fix|permanent fix baaki|needs permanent repair",
    "brake_work": r"(?<![a-z0-9_])brake(?![a-z0-9_])|brake pad|brake drum|(?<![a-z0-9_])pad(?![a-z0-9_])|(?<![a-z0-9_])drum(?![a-z0-9_])",
    "permanent_repair": r"replaced|replace kiya|naya lagwaya|repaired and tested|overhaul",
    "road_tested": r"road test ok",
    "under_warranty": r"under warranty",
}
# Detectors of personal data, in the order in which they apply.
DETECTORS = (
    ("EMAIL", r"(?<![A-Za-z0-9_])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![A-Za-z0-9_])"),
    ("AADHAAR", r"(?<![A-Za-z0-9_])\d{4}[ -]\d{4}[ -]\d{4}(?![A-Za-z0-9_])"),
    ("DL_NUMBER", r"(?i)(?<![A-Za-z0-9_])[A-Z]{2}[ -]?\d{2}[ -]\d{11}(?![A-Za-z0-9_])"),
    ("PHONE", r"\+?91[ -]?(?:\d{5}[ -]?\d{5}|\d{10})(?![A-Za-z0-9_])"),
    ("PHONE", r"(?<![\d.])[6-9]\d{9}(?![\d.])"),
)
#: What every detector but that of mails needs: ten digits with at most one blank or dash between neighbours. No mask holds a digit, so a text without it is left alone by all of them.
NUMBER = r"(?:\d[ -]?){9}\d"
# Words that say nothing about a document's subject.
STOPWORDS = (
    "the", "a", "an", "and", "or", "to", "of", "in", "on", "for", "is", "are", "we", "our", "your", "please", "kindly", "as", "at", "be", "it",
    "this", "that", "with", "from", "by",
)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(x: Column | str) -> Column:
    return F.when(_c(x) != "", _c(x))


def reg_key(x: Column | str) -> Column:
    """PRJ-01: upper case, letters and digits only; null gives ''."""
    return F.regexp_replace(F.upper(F.coalesce(_c(x), F.lit(""))), "[^A-Z0-9]", "")


def reg_display(key: Column | str) -> Column:
    """PRJ-02: AA-00-AAA-0000 where the key has that form, else the key, else null."""
    form = r"^([A-Z]{2})(\d{2})([A-Z]{1,3})(\d{4})$"
    return F.when(_c(key).rlike(form), F.regexp_replace(_c(key), form, "$1-$2-$3-$4")).otherwise(blank_to_null(key))


def cite(file: Column | str, place: Column | str) -> Column:
    """PRJ-03: file#place."""
    return F.concat_ws("#", _c(file), _c(place).cast("string"))


def norm_key(x: Column | str) -> Column:
    """PRJ-04: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]", "")


def severity(x: Column | str) -> Column:
    """PRJ-07: HIGH, MEDIUM or LOW; other words upper-cased; blank gives null."""
    s = F.upper(F.trim(_c(x)))
    out = F.when(_c(x).isNull() | (_c(x) == ""), None)
    for name, words in SEVERITIES.items():
        out = out.when(s.isin(*words), name)
    return out.otherwise(s)


def timestamp_of(x: Column | str) -> Column:
    """PRJ-08: struct(iso, ok, form) of epoch seconds or milliseconds, ISO-like and day/month/year texts; offsets are ignored.

    Dates that do not exist are not ok. What no form matches is unparseable: no host date parser is asked.
    """
    s = F.trim(_c(x))
    day, clock = r"^(\d{4})-(\d{2})-(\d{2})", r"[T ](\d{2}):(\d{2})(?::(\d{2}))?"
    dmy_re = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})(?:[T ,]+(\d{1,2}):(\d{2})(?::(\d{2}))?)?"
    # one replacement puts the parts in order, where a part by itself would search the text anew
    iso = F.rpad(F.regexp_replace(s, f"(?s){day}{clock}.*$", "$1-$2-$3T$4:$5:$6"), 19, "0")
    dmy = F.regexp_replace(s, f"(?s){dmy_re}.*$", "$3-0$2-0$1T0$4:0$5:0$6")
    dmy = F.regexp_replace(F.regexp_replace(dmy, r"(?<=[-T:])0(\d\d)", "$1"), "(?<=[T:])0(?=:|$)", "00")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    real = lambda c: F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull()
    make = lambda text, ok, form: F.struct(text.alias("iso"), ok.alias("ok"), F.lit(form).alias("form"))
    yes, no, none = F.lit(True), F.lit(False), F.lit(None).cast("string")
    midnight = F.concat(F.substring(s, 1, 10), F.lit("T00:00:00"))
    return (
        F.when(_c(x).isNull() | (_c(x) == ""), make(none, no, "empty"))
        .when(s.rlike(r"^\d{10}$"), make(stamp(F.timestamp_seconds(s.try_cast("bigint"))), yes, "epoch_s"))
        .when(s.rlike(r"^\d{13}$"), make(stamp(F.timestamp_millis(s.try_cast("bigint"))), yes, "epoch_ms"))
        .when(s.rlike(day + clock), make(iso, real(iso), "iso"))
        .when(s.rlike(day), make(midnight, real(midnight), "iso_date_only"))
        .when(s.rlike(dmy_re), make(dmy, real(dmy), "dd/mm/yyyy"))
        .otherwise(make(none, no, "unparseable"))
    )


def kilometres(x: Column | str) -> Column:
    """PRJ-09: the leading signed decimal, else null."""
    return F.regexp_extract(F.trim(_c(x)), r"^-?\d+(\.\d+)?", 0).try_cast("double")


def _marked(n: Column, pattern: str) -> Column:
    """Whether a pattern of NOTE_MARKERS is in a text: its alternatives are searched for as strings, and those bounded as words once more where the string is there."""
    out = F.lit(False)
    for p in pattern.split("|"):
        word = p.removeprefix("(?<![a-z0-9_])").removesuffix("(?![a-z0-9_])")
        out = out | (n.contains(word) if word == p else n.contains(word) & n.rlike(p))
    return out


def note_flags(note: Column | str) -> dict[str, Column]:
    """PRJ-10: flags of a free-text note; a repair that is marked as temporary is not permanent."""
    n = F.lower(F.coalesce(_c(note), F.lit("")))
    flags = {k: _marked(n, p) for k, p in NOTE_MARKERS.items()}
    return flags | {"permanent_repair": flags["permanent_repair"] & ~flags["jugaad"]}


def short_hash(x: Column | str, n: int = 16) -> Column:
    """STR-06."""
    return F.substring(F.sha2(_c(x), 256), 1, n)


def prefixed_id(prefix: str, kind: str, x: Column | str) -> Column:
    """PRJ-14: a deterministic id from a kind and a key."""
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(F.concat(F.lit(f"{kind}:"), _c(x)), 256), 1, 10)))


def fingerprint(x: Column | str) -> Column:
    """STR-03: hash of the lower-cased text with ASCII white space collapsed."""
    return F.sha2(F.lower(F.btrim(F.regexp_replace(_c(x), "[ \\t\\r\\n]+", " "))), 256)


def js_number(x: Column | str) -> Column:
    """A double as text without a needless fraction."""
    c = _c(x)
    return F.when(c == F.floor(c), c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))


def material_hash(fields: Mapping[str, Column]) -> Column:
    """STR-07: hash of name=value pairs."""
    return short_hash(F.concat_ws("|", *(F.concat(F.lit(f"{k}="), F.coalesce(v, F.lit(""))) for k, v in fields.items())))


def completeness(fields: Iterable[Column]) -> Column:
    """STR-08: how many fields are neither null nor empty."""
    return sum((F.when(f.isNotNull() & (f != ""), 1).otherwise(0) for f in fields), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _possible(text: Column, kind: str) -> Column:
    """Whether a detector of that kind can find anything, by one cheap look at the text for all those of numbers."""
    return F.lit(True) if kind == "PERSON_NAME" else text.contains("@") if kind == "EMAIL" else text.rlike(NUMBER)


def redacted_text(x: Column | str, names: Iterable[str] = ()) -> Column:
    """STR-09, STR-11: the text of redact() alone, as plain compiled expressions; detectors that cannot find anything do not search it."""
    text = _c(x)
    run = lambda t, steps: functools.reduce(lambda t, d: F.regexp_replace(t, d[1], f"[REDACTED:{d[0]}]"), steps, t)
    out = F.when(text.contains("@"), run(text, DETECTORS[:1])).otherwise(text)
    out = F.when(text.rlike(NUMBER), run(out, DETECTORS[1:])).otherwise(out)
    return F.regexp_replace(out, mask, "[REDACTED:PERSON]") if (mask := name_pattern(names)) else out


def redact(x: Column | str, detectors: Iterable[tuple[str, str]] = DETECTORS, names: Iterable[str] = ()) -> Column:
    """STR-09, STR-11: struct(text, hits): masked text and the sorted kinds of what was masked, each tested on the running text."""
    steps = [(kind, pattern, f"[REDACTED:{kind}]") for kind, pattern in detectors]
    if mask := name_pattern(names):
        steps.append(("PERSON_NAME", mask, "[REDACTED:PERSON]"))

    def run(text: Column, left: list[tuple[str, str, str]], hits: list[Column]) -> Column:
        if not left:
            return F.struct(text.alias("text"), F.array_sort(F.array_distinct(F.array_compact(F.array(*hits)))).alias("hits"))
        kind, pattern, instead = left[0]
        masked = F.regexp_replace(text, pattern, instead)
        if kind == "EMAIL":
            masked = F.when(text.contains("@"), masked).otherwise(text)
        return let(masked, lambda after: run(after, left[1:], [*hits, F.when(after != text, kind)]))  # what is masked differs

    return let(_c(x), lambda text: run(text, steps, []))


def scrub_deep(x: Column, kind: T.DataType, names: Iterable[str] = ()) -> Column:
    """STR-14: every text of a nested value, masked; keys and other values stay."""
    if isinstance(kind, T.StringType):
        return redact(x, names=names)["text"]
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda v: scrub_deep(v, kind.elementType, names))
    if isinstance(kind, T.MapType):
        return F.transform_values(x, lambda _, v: scrub_deep(v, kind.valueType, names))
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*(scrub_deep(x[f.name], f.dataType, names).alias(f.name) for f in kind.fields)))
    return x


def html_escape(x: Column | str) -> Column:
    """STR-15."""
    out = _c(x)
    for plain, instead in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain), F.lit(instead))
    return out


def xml_unescape(x: Column | str) -> Column:
    """STR-16: the five named entities; the ampersand last, so nothing is decoded twice."""
    out = _c(x)
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return out


def column_index(ref: Column | str) -> Column:
    """STR-16: the column of a cell reference, A1 being 0."""
    letters = F.split(F.upper(F.regexp_extract(_c(ref), "^[A-Za-z]+", 0)), "")
    return F.aggregate(letters, F.lit(0), lambda n, ch: F.when(ch == "", n).otherwise(n * 26 + F.ascii(ch) - 64)) - 1


def name_pattern(names: Iterable[str]) -> str:
    """STR-11: one alternation of names of three letters or more, longest first, bounded as words."""
    clean = sorted({n.strip().lower() for n in names if len(n.strip()) >= 3}, key=lambda n: (-len(n), n))
    quoted = ["\\Q" + n.replace("\\E", "\\E\\\\E\\Q") + "\\E" for n in clean]
    return f"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(quoted)})(?![A-Za-z0-9_])" if quoted else ""


def violations(x: Column | str, allow: Iterable[str] = (), names: Iterable[str] = ()) -> Column:
    """FLT-12: kinds of personal data in a text, allowed strings left aside."""
    text = _c(x)
    for a in allow:
        text = F.replace(text, F.lit(a), F.lit(" "))
    steps = list(DETECTORS)
    if mask := name_pattern(names):
        steps.append(("PERSON_NAME", mask))
    # kinds in alphabetical order, as one text: no lambda, so the expression is compiled and the text is made once for all detectors
    by_kind = {kind: [p for k, p in steps if k == kind] for kind in sorted({k for k, _ in steps})}
    found = [F.when(functools.reduce(Column.__or__, (_possible(text, kind) & text.rlike(p) for p in patterns)), kind) for kind, patterns in by_kind.items()]
    said = F.concat_ws(",", *found)
    return F.when(said == "", F.array().cast("array<string>")).otherwise(F.split(said, ","))


def pseudonym(x: Column | str, kind: str, key: bytes) -> Column:
    """STR-10: keyed pseudonym, HMAC-SHA256 as a native expression."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    pads = [bytes(b ^ p for b in key.ljust(64, b"\0")) for p in (0x36, 0x5C)]
    inner, outer = (F.unhex(F.lit(p.hex())) for p in pads)
    message = F.concat(F.lit(f"{kind}:"), F.upper(F.btrim(F.regexp_replace(_c(x), "[ \\t\\r\\n]+", " ")))).cast("binary")
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)
    return F.concat(F.lit(f"{kind}-"), F.upper(F.substring(digest, 1, 10)))


def preview(word: Column | str) -> Column:
    """STR-12: first character, the rest starred."""
    return F.concat(F.substring(_c(word), 1, 1), F.repeat(F.lit("*"), F.length(_c(word)) - 1))


def subject_tokens(x: Column | str) -> Column:
    """STR-04: distinct lower-case words of three letters or more without masks, dates and stop words."""
    t = F.lower(F.coalesce(_c(x), F.lit("")))
    t = F.regexp_replace(t, r"\[redacted:[a-z_]+\]", " ")
    t = F.regexp_replace(t, r"(?<![a-z0-9_])\d{1,2}\s+[a-z0-9_]{3}\s+20\d\d(?![a-z0-9_])", " ")
    words = F.split(F.regexp_replace(t, "[^a-z0-9]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS)))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """SET-05, STR-05: of two arrays of distinct values; both empty are equal."""
    both, any_ = F.size(F.array_intersect(_c(a), _c(b))), F.size(F.array_union(_c(a), _c(b)))
    return F.when(any_ == 0, F.lit(1.0)).otherwise(both / any_)


def days_between(a: Column | str, b: Column | str) -> Column:
    """DAT-01: whole days by date."""
    return F.datediff(_c(b).cast("date"), _c(a).cast("date"))


def months_between(a: Column | str, b: Column | str) -> Column:
    """DAT-02: whole months, one less where the day of the month has not come."""
    x, y = _c(a).cast("date"), _c(b).cast("date")
    return 12 * (F.year(y) - F.year(x)) + F.month(y) - F.month(x) - F.when(F.day(y) < F.day(x), 1).otherwise(0)


def padded_hours(hours: Column | str, percent: float) -> Column:
    """MTH-01."""
    return F.ceil(_c(hours).cast("double") * (1 + percent / 100.0)).cast("bigint")


def in_hours(hour: Column | str, start: int, stop: int) -> Column:
    """FLT-07: start <= hour < stop, over midnight where start is the greater."""
    h = _c(hour)
    return (h >= start) & (h < stop) if start <= stop else (h >= start) | (h < stop)
