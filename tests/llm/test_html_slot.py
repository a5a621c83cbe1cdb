"""The slot of a page with further siblings, copies among the exemplars, and long lists of children."""

from tallyforge.llm import html_wrapper as h


def template_of(pages):
    return h.load(h.json.loads(h.induce(pages)))


def long_text(i):
    return " ".join(f"word{i}x{j}" for j in range(60))


def layout(i, more="", slot="<div>"):
    return f"<div>Site name</div>{slot}<p>{long_text(i)}</p></div>{more}<div>Copyright line</div>"


def test_extra_sibling_is_not_taken_for_the_slot():
    for slot in ("<div>", "<div class=content>", "<div class=post>", "<div class=c7>"):
        template = template_of([layout(i, slot=slot) for i in range(5)])
        for more in ("<div>Buy this</div>", "<div><p>Buy</p><p>this</p></div>"):
            assert h.extract(layout(9, more, slot), template) == long_text(9)


def test_slot_with_little_text_gives_way():
    template = template_of([layout(i) for i in range(5)])
    page = f"<div>Site name</div><section><p>{long_text(9)}</p></section><div>Buy this</div><div>Copyright line</div>"
    assert long_text(9) in h.extract(page, template)


def test_copies_are_one_exemplar(spark):
    page = lambda i: f"<header>Mast</header><div><p>{long_text(i)}</p></div>"
    rows = [(i, f"http://h.example/{i}", page(0)) for i in range(2000)] + [(9000 + i, f"http://h.example/x{i}", page(i)) for i in range(1, 4)]
    got = {r.page_id: r.text for r in h.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: long_text(0) for i in range(2000)} | {9000 + i: long_text(i) for i in range(1, 4)}


def test_nothing_varies():
    assert h.induce([f"<!-- {i} --><header>Mast</header><div><p>same</p></div>" for i in range(5)]) is None


def test_long_lists_are_aligned_whole():
    wide = lambda i: "".join(f"<p>Template line {j}</p>" for j in range(100)) + f"<div><p>{long_text(i)}</p></div>" + "".join(f"<p>Template line {j}</p>" for j in range(100, 200))
    template = template_of([wide(i) for i in range(5)])
    assert h.extract(wide(9), template) == long_text(9)


def plain_match(a, b):
    if a.tag != b.tag:
        return 0
    x, y = a.nodes(), b.nodes()
    best = {(i, j): 0 for i in range(len(x) + 1) for j in range(len(y) + 1)}
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + plain_match(p, q))
    return 1 + best[len(x), len(y)]


def test_matches_are_best(monkeypatch):
    import random

    r = random.Random(3)
    tree = lambda n: h.parse("".join(r.choice(["<div></div>", "<ul><li>a<li>b</ul>", "<ul><li>a</ul>", "<p>x</p>", "<div><p>a</p><h2>b</h2></div>"]) for _ in range(n)))
    for wide, held in ((400, 1 << 22), (0, 1 << 22), (0, 16)):
        monkeypatch.setattr(h, "WIDE", wide)
        monkeypatch.setattr(h, "HELD", held)
        for _ in range(30):
            a, b = tree(r.randrange(30)), tree(r.randrange(30))
            want = plain_match(a, b)
            assert h.tree_match(a, b) == want == len(list(h.align(a, b)))
