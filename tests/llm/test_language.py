from ledgerspark.llm.common import documents
from ledgerspark.llm.language import fit, held_out, identify, train_rows
from tests.llm.helpers import awkward, docs_of, empty

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_rejection(spark):
    docs = documents(spark, DATA)
    model = fit(train_rows(docs))
    found = identify(docs.where(held_out()), model, keep=True).collect()
    right = sum(r["lang_pred"] == r["lang"] for r in found)
    assert right / len(found) > 0.95
    assert sum(r["rejected"] for r in found) / len(found) < 0.01
    assert all(0 <= r["score"] <= 1 for r in found)
    odd = {r["doc_id"]: r for r in identify(awkward(spark), model).collect()}
    assert all((odd[i]["lang_pred"], odd[i]["rejected"]) == ("und", True) for i in (0, 1, 2))
    other = docs_of(spark, ["Съешь же ещё этих мягких французских булок, да выпей чаю. Широкая электрификация южных губерний даст мощный толчок. " * 8])
    assert identify(other, model).first()["rejected"]  # a script that no language of the sample has
    assert identify(empty(spark), model).count() == 0


def test_without_labels(spark):
    model = fit(awkward(spark))
    assert {r["lang_pred"] for r in identify(awkward(spark), model).collect()} == {"und"}


def test_copies_leave_no_language_out(spark):
    """Thousands of copies of one text in a language weigh as one; the other language keeps its centroids, and a fit repeats."""
    texts = ["aba abba baab abab " * 3] * 3000 + [f"xyx zyz yxz{'z' * (i % 7)} zzy {'xy' * (i % 11)}" for i in range(400)]
    docs = docs_of(spark, texts, {i: "aa" if i < 3000 else "bb" for i in range(len(texts))})
    model, again = fit(docs, sample=100), fit(docs.repartition(7), sample=100)
    assert model.languages == ["aa", "bb"]
    assert set(model.owner.tolist()) == {0, 1}
    assert (model.centroids == again.centroids).all()
    found = {r["doc_id"]: r["lang_pred"] for r in identify(docs, model).collect()}
    assert found[0] == "aa"
    assert sum(found[i] == "bb" for i in range(3000, 3400)) > 390


def test_against_plain_centroids(spark):
    """The prediction is the language whose centroid has the largest cosine, computed plainly."""
    import numpy as np

    from ledgerspark.llm.language import SIZE, gram_counts

    texts = ["the cat and the dog", "a dog and a cat", "le chat et le chien", "un chien et un chat"]
    langs = {0: "en", 1: "en", 2: "fr", 3: "fr"}
    docs = docs_of(spark, texts, langs)
    model = fit(docs)
    df = np.zeros(SIZE)
    for t in texts:
        df[gram_counts(t)[0]] += 1

    def vector(text):
        out = np.zeros(SIZE)
        at, n = gram_counts(text)
        out[at] = (1 + np.log(n)) * (np.log(5 / (df[at] + 1)) + 1)
        return out / np.linalg.norm(out)

    asked = ["the dog", "le chien", "a cat and a chat", "et un"]
    got = [(r["lang_pred"], r["score"]) for r in identify(docs_of(spark, asked), model).orderBy("doc_id").collect()]
    for text, (lang, score) in zip(asked, got, strict=True):
        near = [float(vector(text) @ vector(t)) for t in texts]  # two texts of a language are two centroids
        assert lang == langs[int(np.argmax(near))]
        assert abs(score - max(near)) < 1e-5


def test_columns_that_clash(spark):
    docs = docs_of(spark, ["some text"]).selectExpr("*", "'mine' as lang_pred", "'r' as r")
    got = identify(docs, fit(docs_of(spark, ["some text"], {0: "en"})), keep=True)
    assert got.columns == [*docs.columns, "_lang_pred", "_score", "rejected"]
    assert (got.first()["lang_pred"], got.first()["score"], got.first()["_lang_pred"]) == ("mine", 1, "en")
