import math
import zlib
from collections import Counter, defaultdict

import pytest

from ledgerspark.llm import lm_scoring
from tests.llm.helpers import awkward, docs_of, empty, solid_words


def discounts(values):
    n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
    return (0, *lm_scoring._discounts(n))


def test_against_plain_model(spark):
    words = "the of and that thing is it was on a b c d e f g".split()
    texts = [" ".join(words[(i * j + i // 3) % len(words)] for j in range(1, 3 + i % 17)) for i in range(150)] + ["", None, "unseen Words of"]
    docs = docs_of(spark, texts)
    model = lm_scoring.train(docs.where(~lm_scoring.held_out()), shards=3)
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, model).collect()}
    tokens = {i: [*solid_words(t), None] for i, t in enumerate(texts)}
    c, b = Counter(), Counter()
    for i, own in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(own)
            b.update(zip([0, *own[:-1]], own, strict=True))
    total, types = sum(c.values()), len(c)
    assert (model.tokens, model.types, model.bigrams) == (total, types, len(b))
    cont = Counter(w for _, w in b)
    ctx, kinds = Counter(), defaultdict(lambda: [0, 0, 0])
    for (u, _), n in b.items():
        ctx[u] += n
        kinds[u][min(n, 3) - 1] += 1
    low, high = discounts(cont.values()), discounts(b.values())
    rest = sum(low[min(v, 3)] for v in cont.values()) / len(b)

    def prob(u, w):
        p = max(cont[w] - low[min(cont[w], 3)], 0) / len(b) + rest / (types + 1)
        if not ctx[u]:
            return p
        n = b[u, w]
        return max(n - high[min(n, 3)], 0) / ctx[u] + sum(high[k + 1] * kinds[u][k] for k in range(3)) / ctx[u] * p

    for i, own in tokens.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"]) == (len(own), sum(c[w] > 0 for w in own))
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (total + types + 1)) for w in own))
        assert r["score"] == pytest.approx(sum(math.log10(prob(u, w)) for u, w in zip([0, *own[:-1]], own, strict=True)))
    # Over all next words and an unknown one, probabilities add up to one.
    assert sum(prob("the", w) for w in c) + prob("the", "never") == pytest.approx(1)


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert lm_scoring.score(docs, lm_scoring.train(docs)).where("score <= 0 and n_tokens > 0").count() == 12
    untrained = lm_scoring.score(docs, lm_scoring.train(empty(spark))).where("doc_id = 3").first()
    assert untrained["n_known"] == 0
    assert lm_scoring.score(empty(spark), lm_scoring.train(docs)).count() == 0
