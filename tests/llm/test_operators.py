"""The ten operators against brute force, round trips and held-out labels, with the odd rows that each must stand."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("tallyforge.llm")
import public_tokenizers
from pyspark.sql import functions as F

from tallyforge.llm import html_wrapper, neardup_vectors, ngram_join, packing, progressive_jpeg, quality, shingles, suffix_dedup, toxicity, piece_scan, warc
from tallyforge.llm.components import Forest, connected_components

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice("ka lo mi ne tu sa ro pe vi du".split()) + r.choice("ra se ti on um".split()) + str(r.randrange(40)) for _ in range(n))


BASE = words(260, 1)
#: Null, empty and blank texts, repeats, copies, near copies, a shared passage, odd characters, a long word.
TEXTS = [None, "", "  \n", "a", "b c", BASE, BASE, BASE.replace("ka", "kz", 1), words(200, 2) + " " + " ".join(BASE.split()[40:110]) + " " + words(30, 3), "Ünïcode ▁ déjà vu 日本語 😀 \x00\x1f", "x" * 3000, words(900, 4), "ab" * 300, words(150, 5).upper()]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "clash", 1.5) for i, t in enumerate(TEXTS)] + [(5, BASE, "en", "s", 1, "clash", None), (None, "no id here", "en", "s", 1, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, score double").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def table(df):
    return df.toPandas()


# ---- 1


def whole_scan(p, text, chunk):
    """The scan of one text, on the driver."""
    spans = list(piece_scan.spans(piece_scan.escape(text), chunk, p.longest))
    matrices = [piece_scan.transfer(p, s) for s in spans]
    ways = [np.zeros(1)]
    for m in matrices:
        ways.append((ways[-1][:, None] + m).max(0))
    states = [int(np.argmax(ways[-1]))]
    for v, m in zip(ways[-2::-1], matrices[::-1], strict=True):
        states.append(int(np.argmax(v + m[:, states[-1]])))
    states.reverse()
    return [x for s, i, j in zip(spans, states, states[1:], strict=False) for x in piece_scan.backtrace(p, s, i, j)]


def test_scan_gives_the_librarys_ids_on_every_text():
    p = piece_scan.pieces_of(PIECES)
    texts = [t for t in TEXTS if t] + ["  a  b ", "the theatre and the end", "Zürich" * 40, "https://example.org/" + "aGVsbG8" * 30, "日本語" * 30, "\u2581\u2581 x"]
    texts += [t[:3000] for t in pd.read_parquet("/root/testdata/sf0.001/documents.parquet").text if t]
    for t in texts:
        want = p.model.encode(t)
        assert whole_scan(p, t, 30) == want and whole_scan(p, t, 257) == want
        assert piece_scan.decode(p, want) == t.replace("▁", " ")


def test_pieces_of_short_texts_are_the_librarys():
    p = piece_scan.pieces_of(PIECES)
    for t in ["a", "aaaaaaa", "theatre", "ﬁnal", "x😀y", "retinting"]:
        assert [i for x in p.merged(piece_scan.escape(t)) for i in p.ids(x)] == p.model.encode(t)


@pytest.mark.parametrize("chunk", [40, 100, 1000])
def test_scan_equals_the_whole(spark, docs, chunk):
    cols = ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256"]
    whole = sorted(map(tuple, piece_scan.encode_documents(docs, PIECES, chunk=10**6).select(cols).fillna(-1).collect()))
    parts = sorted(map(tuple, piece_scan.encode_documents(docs, PIECES, chunk=chunk).select(cols).fillna(-1).collect()))
    assert parts == whole and len(whole) == len(TEXTS) + 2


def test_transfer_matrices_are_associative():
    p = piece_scan.pieces_of(PIECES)
    m = [piece_scan.transfer(p, s) for s in piece_scan.spans(piece_scan.escape("abracadabra" * 9 + " end"), 20, p.longest)]
    left = piece_scan.combine(piece_scan.combine(m[0], m[1]), m[2])
    assert np.array_equal(left, piece_scan.combine(m[0], piece_scan.combine(m[1], m[2])))


def test_encode_nothing(none):
    assert piece_scan.encode_documents(none, PIECES).count() == 0


# ---- 2


def test_weak_labels_find_the_planted_accuracies():
    r = np.random.default_rng(3)
    truth = r.random(4000) < 0.7
    accuracy = [0.95, 0.9, 0.8, 0.85, 0.9, 0.75, 0.92]
    v = np.stack([np.where(r.random(4000) < 0.3, 2, np.where(r.random(4000) < a, truth, ~truth)) for a in accuracy], 1).astype(np.int8)
    kinds, counts = np.unique(v, axis=0, return_counts=True)
    model = quality.expectation_maximisation(kinds, counts.astype(float))
    assert abs(model.good - 0.7) < 0.05
    assert all(abs(model.says[i][1, 1] - a) < 0.05 for i, a in enumerate(accuracy))
    assert ((model.posterior(v) > 0.5) == truth).mean() > 0.95


def plain_measures(text):
    """The measures of one text in plain Python."""
    raw = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in raw))
    n, size = max(len(words), 1), max(len(raw), 1)
    fives = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = sum(k for k in Counter(fives).values() if k > 1)
    return [sum(c in b"%*$&#|!<>{}[]\\^~=_@+" for c in raw) / size, sum(65 <= c <= 90 for c in raw) / size, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
            1 - len(set(words)) / n if words else 0, max(Counter(words).values(), default=0) / n, sum(map(len, words)) / n, many / n], len(words)


def test_measures_equal_plain_ones():
    texts = [t or "" for t in TEXTS] + ["a a a a a a a b", "x " * 40, "A%b *c* A%b", "one two three four five one two three four five"]
    raw = [t.encode() for t in texts]
    got, n = quality.measures(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    for t, values, words in zip(texts, got, n, strict=True):
        want, count = plain_measures(t)
        assert count == words and np.allclose(values[words and slice(None) or slice(0, 2)], want[words and slice(None) or slice(0, 2)])


def test_quality_against_labels(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = table(quality.score_quality(d, quality.train(d)).select("doc_id", "quality_kept")).merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"))
    assert got[got.quality == 1].quality_kept.mean() > 0.97
    assert got[got.quality == 0].quality_kept.mean() < 0.15


def test_quality_stands_odd_rows(docs, none):
    out = quality.score_quality(docs.withColumn("quality_score", F.lit("clash")), quality.train(docs))
    assert set(out.columns) == {*docs.columns, "quality_score", "weak_posterior", "quality_kept"} and out.count() == docs.count()
    assert len({round(r.quality_score, 12) for r in out.filter(F.col("text") == BASE).collect()}) == 1
    assert quality.score_quality(none, quality.train(none)).count() == 0


# ---- 3


def test_toxicity_on_held_out_labels(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    d = d.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = table(toxicity.score_toxicity(d.select("doc_id", "text"), toxicity.train(d, labels)).withColumn("held_out", toxicity.held_out(F.col("doc_id")))).merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"))
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = got[got.held_out]
    assert held[held.toxic == 1].predicted.mean() > 0.8
    assert held[held.toxic == 0].predicted.mean() < 0.02
    assert held.score.between(0, 1).all() and ((held.score >= 0.3) == (held.predicted == 1)).all()


def test_toxicity_stands_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(5, 1, 0), (None, 1, 1), (3, 0, None), (4, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    out = toxicity.score_toxicity(docs, toxicity.train(docs, labels))
    assert out.count() == docs.count() and out.filter("score is null").count() == 0
    assert toxicity.score_toxicity(none, toxicity.train(none, labels.limit(0))).count() == 0


def test_compression_tells_toxic_words():
    ordinary = [words(60, i) for i in range(60)]
    model = toxicity.fit([words(60, 100 + i).replace(" ", " blurgh ", 3) for i in range(30)], ordinary)
    measure = model.distances()
    assert measure.document("so blurgh it is, Blurgh!")[1] == 2 and measure.document(ordinary[0])[1] == 0
    assert model.score(*measure.document("a blurgh")[:2]) >= 0.3 > model.score(*measure.document("")[:2])


# ---- 4


def check_packing(pieces, texts, capacity):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(WORDS)
    for rows in pieces.groupby("sequence_id"):
        x = rows[1].sort_values("offset")
        assert (x.offset == x.length.cumsum() - x.length).all() and x.length.sum() <= capacity
    for key, rows in pieces.groupby("key"):
        ids = [*tk.encode(texts[key] or "", add_special_tokens=False).ids, 1]
        x = rows.sort_values("start")
        assert (x.start == x.length.cumsum() - x.length).all() and x.length.sum() == len(ids) and (x.doc_tokens == len(ids)).all()
        for r in x.itertuples():
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32


def test_packing(spark, docs, none):
    unique = docs.dropDuplicates(["doc_id"]).fillna(99, ["doc_id"])
    texts = {r.doc_id: r.text for r in unique.collect()}
    out = table(packing.pack(unique, WORDS, capacity=128, grain=32)).rename(columns={"doc_id": "key"})
    check_packing(out, texts, 128)
    assert packing.pack(none, WORDS).count() == 0
    assert packing.pack(docs, WORDS).groupBy("doc_id", "start").count().filter("doc_id = 5 and start = 0").first()["count"] == 2


def test_packing_pads_little(spark):
    out = table(packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), WORDS))
    assert out.sequence_id.nunique() * 2048 < 1.02 * out.length.sum()


def test_differencing_balances():
    sizes = np.random.default_rng(1).integers(1, 500, 300)
    bins = packing.differencing(sizes, 20)
    assert sorted(i for b in bins for i in b) == list(range(300))
    loads = [sizes[b].sum() for b in bins]
    assert max(loads) - min(loads) <= 5
    assert packing.windows(np.array([3, 3, 3]), 4) and len(packing.windows(np.array([3, 3, 3]), 4)) == 3


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tk, e = Tokenizer.from_file(WORDS), packing.encoder(WORDS)
    texts = [t or "" for t in TEXTS] + ["don't \"'s\" it's 'tuff we've 're'll x' d12\x1c3 \x0bA", "Œuvre ſ ± éÉ <|endoftext|>x", "İstanbul ΣΑΣ ς"]
    ids, at = e.encode(texts, 1)
    for t, i, j in zip(texts, at, at[1:], strict=False):
        assert ids[i:j].tolist() == [*tk.encode(t, add_special_tokens=False).ids, 1]


# ---- 5


def test_warc_round_trip(spark):
    big, rows = "<p>" + "x" * 200, []
    rows = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", big), (7, "u", "é" * 60)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    got = {r.page_id: r for r in warc.read_archives(warc.to_archives(pages)).collect()}
    for page_id, _, html in rows:
        raw = (html or "").encode()
        r = got[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 1) if html == big and page_id != 1 else ("response", None))
    assert warc.read_archives(warc.to_archives(pages.limit(0))).count() == 0


def test_warc_reader_finds_damage(tmp_path, spark):
    one = warc.write_record(1, "u", b"payload" * 50, hashlib.sha256(b"payload" * 50).hexdigest(), None, False)
    for step in (1, 7, 1 << 16):
        records = list(warc.WarcReader([one[:9], one[9:], one], keep=True, step=step))
        assert [r.payload for r in records] == [b"payload" * 50] * 2
    for bad in (one[:-5], one[: len(one) // 2] + b"\0" + one[len(one) // 2 + 1 :], warc.write_record(1, "u", b"x", "0" * 64, None, False)):
        with pytest.raises(warc.WarcError):
            list(warc.WarcReader([bad]))
    pages = spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string")
    warc.write_warc_files(warc.to_archives(pages), str(tmp_path)).collect()
    assert warc.read_warc_files(spark, str(tmp_path)).first().page_id == 1


# ---- 6


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_jaccard_join_is_exact(spark, docs, none):
    r = random.Random(9)
    rows, base = [(i, t) for i, t in enumerate(TEXTS)], BASE.split()
    for i in range(100, 220):
        w = list(base)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(len(w))] = f"z{r.randrange(9999)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, n_shingles string")
    sets, forest = {i: shingle_set(t, 4) for i, t in rows}, Forest()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                forest.union(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_sets(df, 4, 85, 100).collect()}
    assert got == {i: (len(s), forest.root(i)) for i, s in sets.items()}
    odd = ngram_join.similar_sets(docs, 4, 85, 100)
    assert odd.count() == docs.count() and odd.filter("doc_id is null").first().component_id is None
    assert ngram_join.similar_sets(none).count() == 0


def test_made_up_words_stay_apart(spark):
    """Thue-Morse words collide under any rolling hash modulo 2 ** 64."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    df = spark.createDataFrame([(1, a), (2, b), (3, a), (4, f"x {a} y z"), (5, f"x {b} y z")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.similar_sets(df, 4, 85, 100).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_hot_buckets_and_members_are_split(spark, monkeypatch):
    """A bucket of many components, cut into pairs of blocks, gives the links of the whole."""
    monkeypatch.setattr(ngram_join, "BUCKET", 16)
    monkeypatch.setattr(ngram_join, "MEMBER", 4)
    r = random.Random(12)
    texts = []
    for i in range(60):  # a chain of neighbours: links beyond the leader's
        texts.append(" ".join(f"w{j}" for j in range(i * 2, i * 2 + 40)) + " end of it")
    texts += [f"{texts[0]} more{i}" for i in range(40)] + [" ".join(f"v{r.randrange(30)}" for _ in range(30)) for _ in range(20)]
    sets, forest = [shingle_set(t, 4) for t in texts], Forest()
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                forest.union(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_sets(df, 4, 85, 100).collect()}
    assert got == {i: (len(s), forest.root(i)) for i, s in enumerate(sets)}


def test_bounds_never_cut_links():
    r = np.random.default_rng(2)
    for n in (1, 5, 80, 700):
        x = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: max(1, int(len(x) * 0.9))], r.integers(0, 1 << 62, max(1, n // 10)).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        assert ngram_join.difference_bound(ngram_join.parities(x), ngram_join.parities(y)) <= len(x) + len(y) - 2 * both
        assert ngram_join.suffix_bound(x, y) >= both
        assert ngram_join.linked(x, y, 80, 100) == (100 * both >= 80 * (len(x) + len(y) - both))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (300, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, 300: 100}
    assert connected_components(edges.limit(0)).count() == 0


# ---- 7


def brute_kept(texts, length):
    return [bytes(np.frombuffer(t, np.uint8)[~c]) for t, c in zip(texts, covered(texts, length), strict=True)]


def brute_repeats(texts, length):
    return [(len(t), int(c.sum()), int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~c])).hexdigest()) for t, c in zip(texts, covered(texts, length), strict=True)]


def covered(texts, length):
    seen = {}
    for i, t in enumerate(texts):
        for j in range(len(t) - length + 1):
            seen.setdefault(t[j : j + length], []).append((i, j))
    cover = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, j in places:
                cover[i][j : j + length] = True
    return cover


def test_repeats_are_exact(spark, docs, none):
    rows = docs.select("doc_id", "text").collect()
    want = brute_repeats([(r.text or "").encode() for r in rows], 200)
    got = suffix_dedup.remove_repeats(docs, keep_text=True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    key = lambda x: tuple("" if v is None else str(v) for v in x)
    assert sorted(map(key, got.collect())) == sorted(key((r.doc_id, *w)) for r, w in zip(rows, want, strict=True))
    assert suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize(("group", "bits", "piece"), [(1500, 28, 1 << 20), (4, 28, 150), (6, 0, 100)])
def test_repeats_of_crowded_anchors(spark, monkeypatch, group, bits, piece):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "MOST_BITS", bits)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    r = random.Random(4)
    core = "".join(r.choice("abcdefgh ") for _ in range(150))
    texts = ["".join(r.choice("abcdefgh ") for _ in range(r.randrange(0, 120))) + core[: r.randrange(60, 151)] + "".join(r.choice("ab") for _ in range(60)) for _ in range(40)]
    texts += ["x" + core + core[40:] * 2 + "y" * 90, "z" + core, "z" + core, None]
    df = spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(texts)], "doc_id long, text string, marks string, found long")
    out = suffix_dedup.remove_repeats(df, length=64, anchor=16)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in out.collect()}
    assert got == dict(enumerate(brute_repeats([(t or "").encode() for t in texts], 64)))
    assert out.columns[:4] == ["doc_id", "text", "marks", "found"]


def test_thousands_of_segments_on_one_anchor(spark):
    """One passage in 3,000 documents with different neighbours: its anchors have far more segments than a part holds."""
    r = random.Random(6)
    passage = "".join(r.choice("abcdefgh ") for _ in range(330))
    noise = lambda: "".join(r.choice("klmnopq ") for _ in range(r.randrange(20, 140)))
    texts = [noise() + passage[r.randrange(0, 60) * (i % 3 == 0) :] + noise() for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.remove_repeats(df).collect()}
    assert got == dict(enumerate(brute_repeats([t.encode() for t in texts], 200)))


def test_merged_transforms_give_the_suffix_order():
    r = random.Random(8)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(20, 60))) for _ in range(30)]
    saved, suffix_dedup.SHARD = suffix_dedup.SHARD, 100
    try:
        got = suffix_dedup.repeated_starts(texts, 12)
    finally:
        suffix_dedup.SHARD = saved
    count = {}
    for t in texts:
        for j in range(len(t) - 11):
            count[t[j : j + 12]] = count.get(t[j : j + 12], 0) + 1
    assert [x.tolist() for x in got] == [[j for j in range(len(t) - 11) if count[t[j : j + 12]] > 1] for t in texts]


# ---- 8

PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a>Home</a><li>More</ul></nav>{extra}<article><h1>Head {i}</h1><p>Text&nbsp;of <b>pa</b>ge {i}<br>line &amp; &#x41;<p>Second<div class='ad'>buy</div><form>mail</form><section id=comments>said</section></article><aside>side</aside><footer>&copy; foot</footer></body></html>"


def test_extraction(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i=i, extra="<div class=cookie-notice>cookies</div>")) for i in range(7)]
    rows += [(20, None, None), (21, "bad url", ""), (22, "http://solo.example", "<p>a<!-- x"), (0, "http://h.example/0", rows[0][2])]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in html_wrapper.extract_pages(pages).collect()]
    want = {i: f"Head {i} Text of page {i} line & A Second" for i in range(7)} | {20: "", 21: "", 22: "a"}
    assert len(got) == len(rows) and all(t == want[i] and n == len(t) for i, _, t, n in got)
    assert html_wrapper.extract_pages(pages.limit(0)).count() == 0


def test_induction_without_marks():
    pages = [f"<div>Site</div><div><div><p>Real {i} text that goes on and on {i}</p></div></div><div>Copyright line</div>" for i in range(5)]
    template = html_wrapper.load(html_wrapper.json.loads(html_wrapper.induce(pages)))
    assert html_wrapper.extract(pages[3], template) == "Real 3 text that goes on and on 3"
    a, b = (html_wrapper.parse(x) for x in ("<ul><li>1<li>2</ul><p>x", "<ul><li>1<li>2<li>3</ul>"))
    assert html_wrapper.tree_match(a, b) == 4


SITE = "<body><div class=a1>Site name <a href=/>Home</a></div><div class=b2>{promo}</div><div><div class=c3><h1>Title {i}</h1><div>{body}</div><div>Printed by the press</div></div></div><div class=d4>Imprint and terms of the site</div></body>"


def site_pages(n):
    bodies = [" ".join(words(60, 40 + i).split()) for i in range(n)]
    return bodies, [SITE.format(i=i, promo="Offer of the day" * (i % 2), body=b) for i, b in enumerate(bodies)]


def test_the_template_decides():
    """Pages without any element or mark that names the article: each differs with and without its host's template, and only the template finds it."""
    bodies, pages = site_pages(12)
    template = html_wrapper.load(html_wrapper.json.loads(html_wrapper.induce(pages[:5])))
    told = [html_wrapper.extract(p, template) for p in pages]
    assert told == [f"Title {i} {b}" for i, b in enumerate(bodies)]
    assert sum(html_wrapper.extract(p, None) != t for p, t in zip(pages, told, strict=True)) == 12


def test_pages_of_one_host_go_through_its_template(spark):
    bodies, pages = site_pages(9)
    df = spark.createDataFrame([(i, "http://plain.example/x", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_wrapper.extract_pages(df).collect()} == {i: f"Title {i} {b}" for i, b in enumerate(bodies)}


def test_hosts_that_tell_nothing_are_judged_by_marks():
    page = "<nav>menu</nav><article><p>one two three</p></article><footer>f</footer>"
    assert html_wrapper.induce([page]) is None
    near = ["<div>menu</div><article><p>" + "same words again " * 30 + x + "</p></article>" for x in ("a", "b", "c")]
    assert html_wrapper.induce(["<article>" + "".join(f"<p>{'para ' * 20}{i}</p>" for i in range(20)) + f"<p>{x}</p></article>" for x in "ab"]) is None
    assert html_wrapper.extract(near[0], None) == ("same words again " * 30 + "a").strip()


def test_deep_trees():
    page = "<div>" * 390 + "<p>deep text</p>" + "</div>" * 390
    assert html_wrapper.extract(page, None) == "deep text"
    pages = [page.replace("deep text", f"deep text number {i} and more of it") for i in range(3)]
    assert html_wrapper.extract(pages[1], html_wrapper.load(html_wrapper.json.loads(html_wrapper.induce(pages)))) == "deep text number 1 and more of it"


# ---- 9


def test_vectors_are_exact(spark):
    r = np.random.default_rng(5)
    centre = r.standard_normal((3, 16))
    x = np.concatenate([centre[i % 3] + 0.06 * r.standard_normal(16) for i in range(90)]).reshape(90, 16).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], i % 2) for i in range(90)] + [(90 + i, rows, 1) for i, rows in enumerate([None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None]])]
    rows += [(200, [float(v) for v in x[0]], 0), (201, [float(v) for v in x[0]], None), (None, [float(v) for v in x[0]], 0)]
    df = spark.createDataFrame([(*v, "clash") for v in rows], "vec_id long, embedding array<float>, label int, links string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup_vectors.near_duplicate_vectors(df).collect()}
    ids = [i for i, v, label in rows if i is not None and label is not None and v and len(v) == 16 and np.isfinite(np.array(v, float)).all() and any(v)]
    by = {i: (np.array(v, float) / np.linalg.norm(np.array(v, float)), label) for i, v, label in rows if i in ids}
    forest, n = Forest(), dict.fromkeys(by, 0)
    for a in by:
        for b in by:
            if a < b and by[a][1] == by[b][1] and by[a][0] @ by[b][0] >= 0.98:
                forest.union(a, b)
                n[a], n[b] = n[a] + 1, n[b] + 1
    want = {i: (n.get(i, 0), forest.root(i) if i in by else i, i is None or (forest.root(i) if i in by else i) == i) for i, *_ in rows}
    assert got == want and max(n.values()) > 3
    assert neardup_vectors.near_duplicate_vectors(df.limit(0)).count() == 0


def test_large_buckets_are_cut(spark, monkeypatch):
    r = np.random.default_rng(6)
    x = r.standard_normal(8) + 0.05 * r.standard_normal((60, 8))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], 0) for i in range(60)], "vec_id long, embedding array<double>, label int")
    whole = sorted(neardup_vectors.near_duplicate_vectors(df).collect())
    monkeypatch.setattr(neardup_vectors, "BLOCK", 7)
    assert sorted(neardup_vectors.near_duplicate_vectors(df).collect()) == whole and max(r.n_links for r in whole) > 7


# ---- 10


def test_media_round_trip(docs, none):
    raw = [(t or "").encode() for t in TEXTS] + [bytes(range(256)) * 3, b"\x80" * 1000, bytes(np.random.default_rng(1).integers(0, 256, 5000, np.uint8))]
    payloads = [progressive_jpeg.padded(x) for x in raw]
    stored = progressive_jpeg.encode_payloads(payloads)
    for p, media, image in zip(payloads, stored, progressive_jpeg.decode_many(stored), strict=True):
        assert progressive_jpeg.payload_of(image) == p and progressive_jpeg.encode_payloads([p]) == [media]
        assert progressive_jpeg.rgb(image).shape == (image.height, image.width, 3)
    got = {(r.doc_id, r.n_bytes): r for r in progressive_jpeg.media_columns(docs).collect()}
    for i, (x, p, media) in enumerate(zip(raw[: len(TEXTS)], payloads, stored, strict=False)):
        r = got[i, len(x)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert progressive_jpeg.media_columns(none).count() == 0
    assert progressive_jpeg.media_columns(docs, keep=True).filter("length(rgb) <> width * height * 3").count() == 0


def test_inverse_transform_is_the_cosine_one():
    c = np.random.default_rng(3).integers(-50, 50, 64)
    u = np.arange(8)
    scale = np.where(u == 0, np.sqrt(0.5), 1)
    square = np.zeros((8, 8))
    square.ravel()[progressive_jpeg.ZIGZAG] = c
    want = [[sum(scale[a] * scale[b] * square[a, b] * np.cos((2 * y + 1) * a * np.pi / 16) * np.cos((2 * x + 1) * b * np.pi / 16) for a in u for b in u) / 4 for x in u] for y in u]
    assert np.allclose((c @ progressive_jpeg.INVERSE).reshape(8, 8), want, atol=1e-3)


def test_damaged_media():
    media = progressive_jpeg.encode_payloads([b"a" * 64])[0]
    for bad in (b"", media[:30], media[:-40], b"\xff\xd8\xff\xc0\0\2"):
        with pytest.raises((progressive_jpeg.JpegError, IndexError)):
            progressive_jpeg.decode(bad)


def test_shingle_hashes_follow_sets():
    raw = [(t or "").encode() for t in TEXTS]
    b, at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    doc, h = shingles.shingle_sets(b, at, 4)
    assert np.bincount(doc, minlength=len(raw)).tolist() == [len(shingle_set(t, 4)) for t in TEXTS]
    assert len(np.unique(h)) == len(set().union(*(shingle_set(t, 4) for t in TEXTS)))
