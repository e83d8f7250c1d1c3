import random

import numpy as np

from ledgerspark.llm import words
from tests.llm.helpers import alnum_words, solid_words


def test_words_match_patterns():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aZ0 é\n\t._-😀b") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", None]
    for table, rule in ((words.ALNUM, alnum_words), (words.SOLID, solid_words)):
        hashes, offsets = words.words_of([t.encode() if t is not None else None for t in texts], table)
        flat = [w for t in texts for w in rule(t)]
        assert np.diff(offsets).tolist() == [len(rule(t)) for t in texts]
        seen = {}
        for w, h in zip(flat, hashes.tolist(), strict=True):
            assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def test_long_texts_are_cut_between_words(monkeypatch):
    texts = [b"ab cde " * 500, b"x" * 3000, b"y z"]
    whole = words.words_of(texts, words.SOLID)
    monkeypatch.setattr(words, "PIECE", 512)
    cut = words.words_of(texts, words.SOLID)
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))


def test_shingles():
    w, o = words.words_of([b"a b c", b"", b"a b c d e f"], words.SOLID)
    h, at = words.shingles_of(w, o, 5)
    assert at.tolist() == [0, 1, 1, 3]
    again, _ = words.shingles_of(*words.words_of([b"b c d e f"], words.SOLID), 5)
    assert h[2] == again[0]
