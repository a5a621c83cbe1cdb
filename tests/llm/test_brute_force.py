"""Operators without SQL against plain versions written apart: labellers by document, trees by full recursion, a JPEG of another encoder."""

import math
import random
import struct

import numpy as np
import pytest

from tallyforge.llm import html_wrapper, progressive_jpeg, quality

# ---- 2: expectation-maximisation, document by document


def plain_em(votes, rounds):
    k = len(votes[0])
    good, says = 0.8, [[[0.5, 0.5], [0.05, 0.95]] for _ in range(k)]
    for _ in range(rounds):
        post = []
        for v in votes:
            a, b = 1 - good, good
            for i, x in enumerate(v):
                if x < 2:
                    a, b = a * says[i][0][x], b * says[i][1][x]
            post.append(b / (a + b))
        for i in range(k):
            for truth, prior in ((0, (2.0, 2.0)), (1, (0.1, 9.9))):
                n = [prior[x] + sum(p if truth else 1 - p for p, v in zip(post, votes, strict=True) if v[i] == x) for x in range(2)]
                says[i][truth] = [x / sum(n) for x in n]
        good = min(0.98, max(0.02, (sum(post) + 0.8 * quality.PRIOR_DOCS) / (len(votes) + quality.PRIOR_DOCS)))
    return good, says, post


def test_labellers_by_document():
    r = random.Random(4)
    votes = []
    for _ in range(400):
        truth = r.random() < 0.7
        votes.append(tuple(2 if r.random() < 0.2 else int(truth if r.random() < p else not truth) for p in (0.9, 0.8, 0.7, 0.6)))
    kinds = sorted(set(votes))
    model = quality.expectation_maximisation(np.array(kinds, np.int8), np.array([votes.count(v) for v in kinds], float), rounds=25)
    good, says, _ = plain_em(votes, 25)
    assert model.good == pytest.approx(good, abs=1e-9) and np.allclose(model.says, says, atol=1e-9)
    _, _, post = plain_em(votes, 26)
    assert np.allclose(model.posterior(np.array(votes, np.int8)), post, atol=1e-9)


# ---- 8: simple tree matching by full recursion


def plain_match(a, b):
    if a.tag != b.tag:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), plain_match(x[0], y[0]) + best(x[1:], y[1:]))

    return 1 + best(a.nodes(), b.nodes())


def grown(r, depth=0):
    node = html_wrapper.Node(r.choice("div p li".split()) if depth else "div")
    for _ in range(r.randrange(4) if depth < 3 else 0):
        node.kids.append(grown(r, depth + 1))
    return node


def test_trees_by_full_recursion(monkeypatch):
    r = random.Random(8)
    for wide in (html_wrapper.WIDE, 0):  # short lists, and the way of long ones
        monkeypatch.setattr(html_wrapper, "WIDE", wide)
        for _ in range(60):
            a, b = grown(r), grown(r)
            known: dict = {}
            html_wrapper.number(a, known)
            html_wrapper.number(b, known)
            assert html_wrapper.tree_match(a, b) == plain_match(a, b)
            pairs = list(html_wrapper.align(a, b))
            assert len(pairs) == plain_match(a, b) and all(x.tag == y.tag for x, y in pairs)


# ---- 10: a progressive JPEG without restart intervals, by a plain encoder of another script


class Bits:
    def __init__(self):
        self.bits, self.used = [], set()

    def put(self, value, n):
        self.bits += [("b", value >> i & 1) for i in reversed(range(n))]

    def symbol(self, s):
        self.used.add(s)
        self.bits.append(("s", s))

    def scan(self):
        """(Huffman table with codes of eight bits, stuffed bytes)."""
        symbols = sorted(self.used)
        flat = []
        for kind, v in self.bits:
            flat += [v] if kind == "b" else [symbols.index(v) >> i & 1 for i in reversed(range(8))]
        flat += [1] * (-len(flat) % 8)
        raw = bytes(int("".join(map(str, flat[i : i + 8])), 2) for i in range(0, len(flat), 8))
        return bytes([*[0] * 7, len(symbols), *[0] * 8, *symbols]), raw.replace(b"\xff", b"\xff\x00")


def put_number(out, v, n):
    out.put(v if v > 0 else v + (1 << n) - 1, n)


def dc(blocks, owner):
    out, last = Bits(), {}
    for (block, k) in zip(blocks, owner, strict=True):
        v = int(block[0]) >> 1
        d, last[k] = v - last.get(k, 0), v
        n = abs(d).bit_length()
        out.symbol(n)
        if n:
            put_number(out, d, n)
    return out


def ac_first(blocks):
    out, run = Bits(), 0

    def end():
        nonlocal run
        if run:
            n = run.bit_length() - 1
            out.symbol(n << 4)
            out.put(run - (1 << n), n)
            run = 0

    for block in blocks:
        r = 0
        for k in range(1, 64):
            v = int(math.copysign(abs(int(block[k])) >> 1, block[k]))
            if not v:
                r += 1
                continue
            end()
            while r > 15:
                out.symbol(0xF0)
                r -= 16
            n = abs(v).bit_length()
            out.symbol(r << 4 | n)
            put_number(out, v, n)
            r = 0
        run += r > 0
        if run == 0x7FFF:
            end()
    end()
    return out


def ac_refine(blocks):
    out = Bits()
    for block in blocks:
        size = [abs(int(v)) for v in block]
        new = max((k for k in range(1, 64) if size[k] == 1), default=0)
        r, corrections = 0, []

        def say(s, *more):
            out.symbol(s)
            for b in (*more, *corrections):
                out.put(b, 1)
            corrections.clear()

        for k in range(1, 64):
            if not size[k]:
                r += 1
                continue
            while r > 15 and k <= new:
                say(0xF0)
                r -= 16
            if size[k] > 1:
                corrections.append(size[k] & 1)
                continue
            say(r << 4 | 1, int(block[k] > 0))
            r = 0
        if r or corrections:
            say(0)
    return out


def foreign(width, height, coefs, sampling, quants):
    segment = lambda m, body: bytes([0xFF, m]) + struct.pack(">H", len(body) + 2) + body
    data = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    for i, q in enumerate(quants):
        data += segment(0xDB, bytes([i, *q]))
    data += segment(0xC2, struct.pack(">BHHB", 8, height, width, 3) + b"".join(bytes([i + 1, h << 4 | v, int(i > 0)]) for i, (h, v) in enumerate(sampling)))
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
    order = [(k, (y * v + b) * across * h + x * h + a) for y in range(down) for x in range(across) for k, (h, v) in enumerate(sampling) for b in range(v) for a in range(h)]

    def add(out, chosen, lo, hi, bits):
        nonlocal data
        table, raw = out.scan()
        if out.used:
            data += segment(0xC4, bytes([16 if lo else 0]) + table)
        data += segment(0xDA, bytes([len(chosen), *(x for k in chosen for x in (k + 1, 0)), lo, hi, bits])) + raw

    add(dc([coefs[k][i] for k, i in order], [k for k, _ in order]), (0, 1, 2), 0, 0, 1)
    own = []
    for k, (h, v) in enumerate(sampling):
        wide, tall = -(-width * h // (8 * hm)), -(-height * v // (8 * vm))
        own.append([y * across * h + x for y in range(tall) for x in range(wide)])
        add(ac_first([coefs[k][i] for i in own[k]]), (k,), 1, 63, 1)
    refine = Bits()
    for k, i in order:
        refine.put(int(coefs[k][i][0]) & 1, 1)
    add(refine, (0, 1, 2), 0, 0, 0x10)
    for k in range(3):
        add(ac_refine([coefs[k][i] for i in own[k]]), (k,), 1, 63, 0x10)
    return data + b"\xff\xd9", own


@pytest.mark.parametrize(("width", "height", "sampling"), [(32, 16, ((2, 2), (1, 1), (1, 1))), (37, 19, ((2, 1), (1, 1), (1, 1))), (9, 30, ((1, 1), (1, 1), (1, 1)))])
def test_a_foreign_progressive_jpeg(width, height, sampling):
    rng = np.random.default_rng(width)
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
    quants = [rng.integers(1, 9, 64).tolist() for _ in range(2)]
    coefs = []
    for h, v in sampling:
        n = across * h * down * v
        c = (rng.normal(size=(n, 64)) * 4 * (rng.random((n, 64)) < 0.15)).astype(int)
        c[:, 0] = rng.integers(-60, 60, n)
        coefs.append(c)
    data, own = foreign(width, height, coefs, sampling, quants)
    for k in range(3):
        coefs[k][[i for i in range(len(coefs[k])) if i not in set(own[k])], 1:] = 0  # blocks beyond the image have no AC scans
    image = progressive_jpeg.decode(data)
    assert (image.width, image.height) == (width, height)
    for k in range(3):
        assert np.array_equal(image.components[k].coef, coefs[k])
    zigzag = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8) * (1 if (i // 8 + i % 8) % 2 else -1)))
    planes = []
    for k, (h, v) in enumerate(sampling):
        plane = np.zeros((down * v * 8, across * h * 8))
        for i, block in enumerate(coefs[k]):
            f = np.zeros((8, 8))
            for z, at in enumerate(zigzag):
                f[at // 8, at % 8] = block[z] * quants[int(k > 0)][z]
            for y in range(8):
                for x in range(8):
                    s = sum((0.5**0.5 if u == 0 else 1) * (0.5**0.5 if w == 0 else 1) * f[w, u] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * w * math.pi / 16) for w in range(8) for u in range(8) if f[w, u])
                    plane[i // (across * h) * 8 + y, i % (across * h) * 8 + x] = min(255, max(0, 128 + s / 4))
        planes.append(plane.repeat(vm // v, 0).repeat(hm // h, 1)[:height, :width])
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    want = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2), 0, 255)
    assert np.abs(progressive_jpeg.rgb(image).astype(float) - want).max() <= 0.51
