"""Ordinary stretches that resemble toxic stems are kept, however many there are."""

import itertools

from tallyforge.llm import toxicity


def test_all_stretches_count(monkeypatch):
    stems = ["".join(x) for x in itertools.islice(itertools.product("klmnoprstuvwyz", "aeiou", "bdfgh", "aeiou", "klmnr", "xjq"), 6000)]
    stems = [s + s[::-1] for s in stems]
    monkeypatch.setattr(toxicity, "toxic_stems", lambda *_: (stems, []))
    words = ["q" + s for s in stems]
    model = toxicity.fit([" ".join(stems[:50])], [" ".join(words[i : i + 100]) for i in range(0, len(words), 100)])
    assert all(s.encode() in model.ordinary for s in stems)
    measure = model.distances()
    assert sum(measure.word(w)[0] >= toxicity.THRESHOLD for w in words) < 1200  # far matches cost a byte more; 1,364 with 4,096 stretches kept
