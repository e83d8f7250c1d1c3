import hashlib
import random

import numpy as np

from ledgerspark.llm.fingerprints import Sketch, sketches, with_edits
from tests.llm.helpers import awkward, docs_of, empty, solid_words


def test_edits_and_order(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(0, 80))) for _ in range(300)] + [None, "", "é😀x"]
    got = {r["doc_id"]: r for r in with_edits(docs_of(spark, texts), least_rows=16).collect()}
    order = sorted(range(len(texts)), reverse=True)
    for k, i in enumerate(order):
        own, nxt = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + nxt[:half]
        assert got[i]["n_chars"] == len(own)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = sketches([own.encode(), edited.encode(), nxt.encode()])
        assert got[i]["near_edited"] == a.likeness(b)
        assert got[i]["near_next"] == a.likeness(c)
        assert Sketch.parse(got[i]["fingerprint"]).likeness(a) == 1.0


def test_estimates_follow_the_true_similarity():
    rng = random.Random(2)
    errors = []
    for _ in range(60):
        a = [str(rng.randint(0, 10**6)) for _ in range(600)]
        b = a[: rng.randint(0, 600)] + [str(rng.randint(0, 10**6)) for _ in range(200)]
        x, y = sketches([" ".join(a).encode(), " ".join(b).encode()])
        s, t = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        errors.append(abs(x.likeness(y) - len(s & t) / len(s | t)))
        errors.append(abs(x.containment(y) - len(s & t) / len(s)))
    assert np.mean(errors) < 0.06


def test_merge_is_union():
    a, b, both = sketches([b"a b c d e f g", b"q r s t u v", b"a b c d e"], scale=1)
    assert set(a.merge(b).hashes) == set(a.hashes) | set(b.hashes)
    assert both.containment(a) == 1.0
    assert len(a.hashes) == len(solid_words("a b c d e f g")) - 4


def test_awkward_rows(spark):
    got = with_edits(awkward(spark)).collect()
    assert len(got) == 12
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 4}) == 1
    assert with_edits(empty(spark)).count() == 0
    assert with_edits(docs_of(spark, ["only one"])).first()["near_next"] == 1.0
