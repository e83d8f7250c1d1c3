from collections import Counter

from pyspark.sql import functions as F

from ledgerspark.llm import quality
from ledgerspark.llm.common import documents
from tests.llm.helpers import awkward, empty

DATA = "/root/testdata/sf0.01"


def test_em_finds_the_rates():
    import numpy as np

    rng, counts = np.random.default_rng(1), Counter()
    for _ in range(20_000):
        good = rng.random() < 0.8
        right = (0.95, 0.9, 0.85, 0.9, 0.8, 0.9, 0.9, 0.9)
        counts["".join("2" if rng.random() < 0.3 else str(int(good if rng.random() < a else not good)) for a in right)] += 1
    model = quality.estimate(counts)
    assert abs(model.prior - 0.8) < 0.03
    for (_, on_good), a in zip(model.accuracies().values(), (0.95, 0.9, 0.85, 0.9, 0.8, 0.9, 0.9, 0.9), strict=True):
        assert abs(on_good - a) < 0.05


def test_agrees_with_labels(spark):
    docs = documents(spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.fit(docs, labels)
    got = quality.classify(docs, model).join(labels.withColumnsRenamed({"quality": "q", "toxic": "t"}), "doc_id").collect()
    good = [r for r in got if r["q"] == 1 and r["t"] == 0]
    assert sum(r["keep"] for r in good) / len(good) > 0.95
    bad = [r for r in got if r["q"] == 0]
    assert sum(not r["keep"] for r in bad) / len(bad) > 0.6
    toxic = [r for r in got if r["t"] == 1]
    assert sum(r["toxic"] for r in toxic) / len(toxic) > 0.7
    assert sum(r["toxic"] for r in good) / len(good) < 0.01


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert quality.classify(docs, quality.fit(docs)).count() == 12
    assert quality.classify(empty(spark), quality.fit(empty(spark))).count() == 0


def test_estimate_against_plain_em():
    """Rates and prior of a small table of votes, by the same steps over single documents."""
    import numpy as np

    from ledgerspark.llm.quality import BAD, GOOD, NAMES, NONE, estimate

    rng = np.random.default_rng(3)
    rows = ["".join(str(rng.choice([GOOD, BAD, NONE], p=(0.6, 0.2, 0.2) if i % 3 else (0.2, 0.6, 0.2))) for _ in NAMES) for i in range(60)]
    counts = {r: rows.count(r) for r in set(rows)}
    model = estimate(counts, rounds=5)
    good = [0.1 if str(BAD) in r else 0.95 for r in rows]
    for _ in range(5):
        prior = min(max((sum(good) + 2) / (len(rows) + 4), 0.02), 0.98)
        rates = {}
        for j in range(len(NAMES)):
            for y in (BAD, GOOD):
                seen = {v: 1.0 + sum((g if y == GOOD else 1 - g) for r, g in zip(rows, good, strict=True) if r[j] == str(v)) for v in (BAD, GOOD)}
                rates[j, y] = seen[BAD] / sum(seen.values())
            rates[j, GOOD] = min(rates[j, BAD], rates[j, GOOD])
        new = []
        for r in rows:
            odds = prior / (1 - prior)
            for j, v in enumerate(r):
                if v == str(BAD):
                    odds *= rates[j, GOOD] / rates[j, BAD]
                if v == str(GOOD):
                    odds *= (1 - rates[j, GOOD]) / (1 - rates[j, BAD])
            new.append(odds / (1 + odds))
        if max(abs(a - b) for a, b in zip(new, good, strict=True)) < 1e-9:
            break
        good = new
    assert abs(model.prior - prior) < 1e-9
    for j in range(len(NAMES)):
        assert abs(model.rates[j, BAD, BAD] - rates[j, BAD]) < 1e-9
        assert abs(model.rates[j, GOOD, BAD] - rates[j, GOOD]) < 1e-9


def test_toxicity_of_held_out_documents(spark):
    """The head is trained on the labels of even doc_ids and judged on those of odd ones."""
    docs = documents(spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    got = quality.classify(docs, model).select("doc_id", "toxic").join(labels.select("doc_id", F.col("toxic").alias("t")).where("doc_id % 2 = 1"), "doc_id").collect()
    marked = [r["toxic"] for r in got if r["t"] == 1]
    assert sum(marked) / len(marked) > 0.6
    clean = [r["toxic"] for r in got if r["t"] == 0]
    assert sum(clean) / len(clean) < 0.02
