import corpus_pipeline
from ledgerspark.llm.common import documents, written

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = documents(spark, DATA)
    n, ids = [docs.count()], {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
            assert out.dtypes == docs.dtypes
            out = written(out, spark)
            docs = out
        now = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert now <= ids
        n.append(len(now))
        ids = now
    assert n[1] >= 0.97 * n[0]
    assert n[-1] == n[-2] > 0


def awkward_docs(spark):
    """Every awkward row, a long text, repeated rows, and columns with results' names."""
    from pyspark.sql import functions as F

    from tests.llm.helpers import awkward, docs_of

    long = docs_of(spark, [" ".join(f"Word{i} follows word{i - 1}." for i in range(20_000))] * 2, {0: "en", 1: "en"}).drop("spans", "score", "n_words")
    names = ("n_words", "n_hit", "items", "spans", "contaminated", "score", "lang_pred", "rejected", "n_lines", "emptied", "t1", "r", "runs")
    return awkward(spark).unionByName(long).withColumns({c: F.lit(f"mine {c}") for c in names})


def test_stages_on_awkward_rows_and_an_empty_table(spark):
    docs = awkward_docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert 0 < len(rows) <= docs.count(), name
        assert all(r["contaminated"] == "mine contaminated" and r["score"] == "mine score" for r in rows), name
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, DATA).count() == docs.count()
    assert last(spark, docs.limit(0), DATA).count() == 0
