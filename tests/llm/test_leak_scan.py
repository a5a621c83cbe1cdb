"""Benchmark windows found by the automaton against a search of word lists."""

import random
import re

from tallyforge.llm import leak_scan
from tallyforge.llm.leak_scan import Automaton, contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items, size=10):
    own, hit, found = words(text), set(), set()
    for item, said in items:
        w = words(said)
        k = min(len(w), size)
        for window in ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else ()):
            for i in range(len(own) - k + 1):
                if tuple(own[i : i + k]) == window:
                    hit |= set(range(i, i + k))
                    if item is not None:
                        found.add(item)
    return len(own), len(hit), sorted(map(str, found))


def made(seed, n=40):
    rng = random.Random(seed)
    some = ["a", "B", "ab", "Ä", "9", "é—x", "b", "I", "ß", "ﬁ"]
    text = lambda k: "".join(rng.choice(some) + rng.choice([" ", "\n", "--", ", ", "\x00", "\x7f", "_"]) for _ in range(k))
    items = [(i if i % 7 else None, text(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(12)] + [(5, "a  B, ab"), (3, None), (77, "a  B, ab")]
    docs = [(i if i % 9 else None, rng.choice([text(rng.randrange(60)), (text(5) + (rng.choice(items)[1] or "") + text(7)), "", None])) for i in range(n)]
    return docs, items


def test_against_word_lists(spark):
    for seed, size, chars in ((1, 10, 10**6), (2, 10, 300), (3, 3, 200)):  # small blocks: several automata whose results are merged
        docs, items = made(seed)
        d = spark.createDataFrame([(*x, "en", 1) for x in docs], "doc_id bigint, text string, items string, n_words int")
        b = spark.createDataFrame([(*x, 2) for x in items], "item_id bigint, text string, doc_id int")
        rows = contamination(d, b, words=size, block_chars=chars).collect()
        want = sorted((str(i), *map(str, plain(t, items, size))) for i, t in docs)
        assert sorted((str(r.doc_id), str(r.n_words), str(r.n_hit), str(r["items"])) for r in rows) == want
        texts = {i: t for i, t in docs if i is not None}
        for r in rows:
            if r.doc_id is not None:
                assert sum(len(words(texts[r.doc_id][s.start : s.end])) for s in r.spans) == r.n_hit
                assert all(words(texts[r.doc_id][a.end : b.start]) for a, b in zip(r.spans, r.spans[1:]))


def test_pieces_do_not_change_results(monkeypatch):
    docs, items = made(4, 60)
    machine = Automaton()
    for i, (_, text) in enumerate(items):
        machine.add(i, text)
    whole = [machine.scan(t) for _, t in docs]
    assert [(w, h) for w, h, _, _ in whole] == [plain(t, items)[:2] for _, t in docs]
    for piece in (1, 7, 40):
        monkeypatch.setattr(leak_scan, "PIECE", piece)
        assert [machine.scan(t) for _, t in docs] == whole


def test_long_text_and_empty_tables(spark):
    leak = "One two three four five six seven eight nine TEN eleven"
    long = "filler words here. " * 400_000 + leak + " more" * 300_000
    d = spark.createDataFrame([(1, long), (2, leak.replace("six", "sax"))], "doc_id bigint, text string")
    b = spark.createDataFrame([(10, leak), (9, leak)], "item_id bigint, text string")
    rows = {r.doc_id: r for r in contamination(d, b).collect()}
    assert (rows[1].n_words, rows[1].n_hit, rows[1]["items"]) == (1_500_011, 11, ["10", "9"])
    assert [long[s.start : s.end] for s in rows[1].spans] == [leak] and rows[2].n_hit == 0
    assert contamination(d.limit(0), b).count() == 0
    assert [r.n_hit for r in contamination(d, b.limit(0)).collect()] == [0, 0]
