import hashlib
import random

import numpy as np

from ledgerspark.llm.decontaminate import FmIndex, decontaminate, digests, suffix_array
from tests.llm.helpers import alnum_words, awkward, docs_of, empty


def test_suffix_array_and_search():
    rng = np.random.default_rng(1)
    for _ in range(30):
        text = np.concatenate(([0], *[np.concatenate((rng.integers(1, 4, rng.integers(1, 30)), [0])) for _ in range(4)])).astype(np.int64)
        assert sorted(suffix_array(text)) == list(range(len(text)))
        index = FmIndex(text, 3, rate=4)
        for n in (1, 2, 3, 5):
            phrase = rng.integers(1, 4, n)
            low, high = index.search(phrase[None, :].astype(np.int64), np.array([n]))
            found = sorted(index.locate(np.arange(low[0], high[0])))
            assert found == [i for i in range(len(text) - n + 1) if (text[i : i + n] == phrase).all()]


def brute(texts, items):
    windows = {}
    for k, t in items:
        w = alnum_words(t)
        for j in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[j : j + 13]), set()).add(str(k))
    out = {}
    for i, t in enumerate(texts):
        w, hit, found = alnum_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (x := tuple(w[j : j + n])) in windows:
                    hit.update(range(j, j + n))
                    found |= windows[x]
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(("an", "of", "the", "tre", "öl", "x1"))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((30, 14, 13, 12, 6, 25))] + [(99, ""), (98, None), (97, "...")]
    texts = []
    for _ in range(120):
        t = [word() if rng.random() < 0.7 else "zz" for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            t.insert(rng.randint(0, len(t)), rng.choice(items)[1] or "")
        texts.append(", ".join(t).upper() if rng.random() < 0.2 else ". ".join(t))
    texts += [None, "", items[0][1] * 2, items[4][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(texts, items)
    for more in ({}, {"block_chars": 60}, {"shard_bytes": 500}):
        got = {r["doc_id"]: tuple(r)[1:6] for r in digests(decontaminate(docs_of(spark, texts).select("doc_id", "text"), bench, **more)).collect()}
        assert got == want
    spans = decontaminate(docs_of(spark, [items[0][1] + " zz " + items[0][1]]), bench).first()["_spans"]  # the table has spans of its own
    assert [(s["start"], s["end"]) for s in spans] == [(0, 30), (31, 61)]


def test_awkward_rows(spark):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    got = digests(decontaminate(awkward(spark), bench)).collect()
    assert sum(r["contaminated"] for r in got) == 2
    assert decontaminate(empty(spark), bench).count() == 0
    assert decontaminate(awkward(spark), bench.limit(0)).where("contaminated").count() == 0
