"""Word shingles of whole texts as 64-bit hashes, computed with arrays over many texts at once."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_rng = np.random.default_rng(17)
SALT = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
STEP = _rng.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9FB21C651E98DF25
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word from which on it is hashed by itself.
LONG_WORD = 256
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers[name]
    if len(have) < n:
        seed = np.full(max(n, 1 << 19), base, np.uint64)
        seed[0] = 1
        have = np.multiply.accumulate(seed)
        if n <= 1 << 20:  # longer ones are not kept
            _powers[name] = have
    return have[:n]


def prefix_sums(b: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any span follows; see span_hash."""
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(SALT[b] * _power("down", INVERSE, len(b)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of spans that depend on their bytes alone. A rolling hash: made-up spans can collide, so equal hashes only bring candidates together."""
    return mix((sums[stop] - sums[start]) * _power("up", BASE, len(sums))[stop] + (stop - start).astype(np.uint64))


def word_hash(b: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of spans, eight bytes a step through the finaliser; long ones one by one."""
    size = stop - start
    h = mix(size.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    wide = np.lib.stride_tricks.as_strided(np.append(b, np.zeros(8, np.uint8)).view(), (len(b) + 1, 8), (1, 1))
    on, at, left = np.nonzero(size < LONG_WORD)[0], 0, size
    while len(on):
        x = wide[start[on] + at].view("<u8").ravel()
        rest = left[on] - at
        short = rest < 8
        x[short] &= (np.uint64(1) << (rest[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        h[on] = mix((h[on] ^ x) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(at + 1))
        at += 8
        on = on[rest > 8]
    long = np.nonzero(size >= LONG_WORD)[0]
    if len(long):
        raw = memoryview(np.ascontiguousarray(b))
        h[long] = [xxhash.xxh3_64_intdigest(raw[i:j], 29) for i, j in zip(start[long].tolist(), stop[long].tolist(), strict=True)]
    return h


_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    """Words as shingle_sets takes them."""
    return _WORD.findall((text or "").translate(_LOWER))


def shingle_sets(b: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document number, hash) of each distinct k-word shingle, by document and hash.

    b: bytes of all texts, at: their n + 1 offsets. A text of fewer than k words but one at least gives
    one hash of them all; A-Z is lower-cased; words are runs of bytes other than white space.
    """
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    b = LOWER[b]
    word = ~SPACE[b]
    new = word.copy()
    new[1:] &= ~word[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    new[first] = word[first]
    start = np.nonzero(new)[0]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gap = ~word
    gap[first] = True  # a text's first byte ends the word before it
    bounds = np.append(np.nonzero(gap)[0], len(b))
    stop = bounds[np.searchsorted(bounds, start, "right")]
    h = word_hash(b, start, stop)
    doc = np.searchsorted(at, start, "right") - 1
    n = np.bincount(doc, minlength=len(at) - 1)
    begin = np.cumsum(n) - n
    # full shingles start at all but a text's last k - 1 words
    index = np.arange(len(start)) - begin[doc]
    full = np.nonzero(index + k <= n[doc])[0]
    total = np.zeros(len(full), np.uint64)
    for i in range(k):
        total += h[full + i] * STEP[i]
    short = np.nonzero((n > 0) & (n < k))[0]
    few = np.zeros(len(short), np.uint64)
    for i in range(k - 1):
        on = n[short] > i
        few[on] += h[begin[short[on]] + i] * STEP[i]
    few += n[short].astype(np.uint64) * STEP[63]
    doc = np.concatenate([doc[full], short])
    h = mix(np.concatenate([total, few]))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[keep], h[keep]
