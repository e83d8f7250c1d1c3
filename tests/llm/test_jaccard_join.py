import random

import numpy as np

from ledgerspark.llm.components import components
from ledgerspark.llm.jaccard_join import GROUPS, CountVectorRTree, enough, jaccard_components
from tests.llm.helpers import awkward, docs_of, empty, solid_words


def brute(texts):
    sets = []
    for t in texts:
        w = solid_words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_against_brute_force(spark):
    rng = random.Random(8)
    common = " ".join(rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(30))
    texts = []
    for _ in range(40):
        base = [rng.choice("abcdefghijklm") * rng.randint(1, 3) for _ in range(rng.randint(1, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = base[:]
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "edit" + str(rng.randint(0, 99))
            texts.append(" ".join(copy) + (" " + common if rng.random() < 0.3 else ""))
    texts += [None, "", " ", "a b", "A  b", texts[0].upper()]
    rng.shuffle(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs_of(spark, texts)).collect()}
    assert got == brute(texts)


def test_a_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:k] + [f"e{k}"] + base[k + 1 :]) for k in range(180)] + ["else " * 9]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(docs_of(spark, texts)).collect()}
    assert {got[i] for i in range(180)} == {0}
    assert got[180] == 180


def test_tree_finds_all():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 4, (500, GROUPS)).astype(np.int32)
    points[250:] = np.maximum(points[:250] + rng.integers(-1, 2, (250, GROUPS)) * (rng.random((250, GROUPS)) < 0.1), 0)
    tree, sizes = CountVectorRTree(points), points.sum(axis=1)
    for q in range(0, 500, 7):
        want = np.flatnonzero(enough(np.minimum(points, points[q]).sum(axis=1), int(sizes[q]), sizes))
        assert sorted(tree.search(points[q])) == want.tolist()


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 40), (41, 50), (60, 61), (60, 62), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 41: 40, 50: 40, 61: 60, 62: 60}


def test_awkward_rows(spark):
    got = jaccard_components(awkward(spark)).collect()
    assert len(got) == 12
    assert [r["component_id"] for r in got if r["doc_id"] == 4] == [4, 4]
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert jaccard_components(empty(spark)).count() == 0


def test_tree_prunes():
    """Of sets of spread sizes the tree leaves few candidates; without near copies nearly none."""
    import numpy as np

    from ledgerspark.llm.jaccard_join import GROUPS, CountVectorRTree

    rng = np.random.default_rng(5)
    sizes = rng.integers(100, 600, 2000)
    points = np.stack([np.bincount(rng.integers(0, GROUPS, n), minlength=GROUPS) for n in sizes]).astype(np.int32)
    tree = CountVectorRTree(points)
    left = [len(tree.search(p)) - 1 for p in points[:200]]
    assert sum(left) < 0.03 * 200 * len(points)
