"""Ticket texts as columns against a plain reading with the json module."""

import json
import random

from tallyforge.sources import delimited, tickets

WORDS = ["id", "vehicle", "registration", "a", "b", "_m", "truck", "rows", "data"]


def plain_flatten(record, prefix="", depth=0, out=None):
    """Fields and nested ones in order; a leaf's bare name only while nothing has it."""
    out = {} if out is None else out
    for k, v in record.items():
        name = f"{prefix}_{k}" if prefix else k
        if isinstance(v, dict) and depth < 2:
            plain_flatten(v, name, depth + 1, out)
            for x, y in v.items():
                if x not in out and not isinstance(y, (dict, list)):
                    out[x] = y
        else:
            out[name] = v
    return out


def plain_container(text, name):
    """(format, records, bad lines)."""
    body, ext = text.strip(), name.rsplit(".", 1)[-1].lower() if "." in name else ""
    try:
        whole = json.loads(body)
    except ValueError:
        whole = None
    if body.startswith("["):
        return "json_array", whole or [], [1] if whole is None else []
    if body.startswith("{"):
        if whole is None:
            good, bad = [], []
            for n, line in enumerate((x for x in body.split("\n") if x.strip()), 1):
                try:
                    good.append(json.loads(line))
                except ValueError:
                    bad.append(n)
            return "jsonl" if good else "unknown", good, bad
        key = next((k for k in tickets.WRAPPERS if isinstance(whole.get(k), list)), None)
        return (f"json_object.{key}", whole[key], []) if key else ("json_single_object", [whole], [])
    first = body.split("\n", 1)[0]
    if ext in ("csv", "tsv", "txt") or any(d in first for d in ",;\t|"):
        d = "\t" if ext == "tsv" else delimited.sniff(body)
        return {",": "csv", ";": "csv_semicolon", "\t": "tsv", "|": "psv"}[d], [{k: v for k, v in r.items() if not k.startswith("_")} for r in delimited.parse_records(text, name, d)], []
    return "unknown", [], []


def value(rng, depth):
    kind = rng.randrange(9 if depth else 6)
    if kind > 6:
        return {k: value(rng, depth - 1) for k in rng.sample(WORDS, rng.randrange(4))}
    return [None, rng.randrange(99), "x", '{"k": 1}', True, "q\"\n\u00e9", [1, {"z": "y"}]][kind]


def texts(n):
    rng = random.Random(11)
    out = []
    for i in range(n):
        some = [{k: value(rng, 4) for k in rng.sample(WORDS, rng.randrange(5))} for _ in range(rng.randrange(1, 4))]
        dump = lambda x: json.dumps(x, ensure_ascii=False)
        out.append([dump([*some, value(rng, 1)]), dump(some[0]), "\n".join(map(dump, some)) + "\n{bad\n\n" + '"text"\n12', dump({"x": 1, "queue": some}), dump(some)[:-1], dump(some[0]) + "]", dump(some[0]) + ' , "y": 0}'][i % 7])
    return out


FIXED = [
    ("", "a"), ("plain", "a"), ("plain", "a.TXT"), ("a;b,c;d\n1;2", "x"), ("h1\th2\n1\t\n", "x.tsv"), ("_m,id,id\nx,1,2\n,,\n\n4\n", "x.csv"), ("  [1, null, \"s\", {\"a\": [ ]}]\n", "x.json"), ("[]", "a"), ("{}", "a"), ("{bad", "a"), ("[1] x", "a"),
    ('{"id": 1}\n{"id": 2}', "a.jsonl"), ('{"tickets": 1, "rows": [], "data": [{"id": 1}]}', "a"), ('a,b\n"x\ny, ""q""",2\n', "x"), ('{"a": "[]", "rows": "[1]"}', "a"), ("{'a': 1}", "a"), ('{"a": NaN}', "a"), ('{"a": 1}\r\n{"a": 2}', "a"),
]


def test_containers_and_entries_equal_the_plain_reading(spark):
    given = [(f"f{i}", x) for i, x in enumerate(texts(280))] + [(n, x) for x, n in FIXED if "NaN" not in x]
    df = spark.createDataFrame([(i, n, x) for i, (n, x) in enumerate(given)], "i int, name string, value string")
    for r in tickets.containers(df).collect():
        form, records, bad = plain_container(given[r.i][1], given[r.i][0])
        assert r.format == form and [json.loads(x.raw) for x in r.records] == [*records, *({"_bad_line": n} for n in bad)], given[r.i]
    got = {}
    for r in tickets.raw_tickets(df.selectExpr("cast(i as string) || '.' || name as name", "value")).collect():
        got.setdefault(int(r.file.split(".")[0]), {})[r.idx] = (r.format, json.loads(r.raw), [(e.key, e.value) for e in r.entries])
    text = lambda v: v if isinstance(v, str) or v is None else json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    for i, (name, x) in enumerate(given):
        form, records, bad = plain_container(x, f"{i}.{name}")
        want = [(form, r, [(k, text(v)) for k, v in plain_flatten(r).items()] if isinstance(r, dict) else []) for r in [*records, *({"_bad_line": n} for n in bad)]]
        assert [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == want, x


def test_odd_texts(spark):
    df = spark.createDataFrame([("a", None), ("b", '{"a": NaN}'), ("c", '{"id": 1, "v": {"id": 2}, "id": 3}'), ("d", '[{"a": 1, "a": "x"}]'), ("e", '{"vehicle": {"id": 1.50}, "id": null}')], "name string, value string")
    assert {r.name: (r.format, [x.raw for x in r.records]) for r in tickets.containers(df).collect() if r.name in "ab"} == {"a": ("unknown", []), "b": ("unknown", ['{"_bad_line":1}'])}
    got = {r.file: [(e.key, e.value) for e in r.entries] for r in tickets.raw_tickets(df).collect()}
    assert got["c"] == [("id", "3"), ("v_id", "2")] and got["d"] == [("a", "x")]
    assert got["e"] == [("vehicle_id", "1.5"), ("id", None)]


def test_a_nested_name_counts_before_a_later_field(spark):
    df = spark.createDataFrame([("a", '{"Ticket-ID": 7, "truck": {"registration": "X 1"}, "plate": "Y 2", "odd": {"deep": {"er": {"est": 1}}}}')], "name string, value string")
    r = tickets.tickets_of(df).first()
    assert (r.ticket_id, r.vehicle, r.citation) == ("7", "X 1", "a#record1")
    assert set(r.unmapped) == {"odd_deep_er", "truck_registration"}
