from ledgerspark.llm.line_dedup import dedup_lines
from tests.llm.helpers import awkward, docs_of, empty

PASSAGE = " ".join(f"Sentence number {i} of the passage that many documents share." for i in range(8))


def own(i, n=6):
    return " ".join(f"Document {i} says thing {k} in words of its own here." for k in range(n))


def test_later_runs_go_and_first_ones_stay(spark):
    texts = [
        own(0) + "\n" + PASSAGE + "\n" + own(100), own(1) + " " + PASSAGE + " tail of one.", own(2), own(2), "Short. Line.\n" + own(3), "Short. Line.\n" + own(4),
        own(5) + "\n" + PASSAGE.replace(" ", "\n", 0), "Les.", "Les.",
    ]
    got = {r["doc_id"]: r for r in dedup_lines(docs_of(spark, texts)).collect()}
    assert got[0]["text"] == texts[0]
    assert PASSAGE[:200] not in got[1]["text"]
    assert own(1) in got[1]["text"]
    assert "tail of one." in got[1]["text"]
    assert got[1]["n_removed"] == 8
    assert (got[2]["emptied"], got[3]["emptied"], got[3]["text"]) == (False, True, "")
    assert got[4]["text"] == texts[4]
    assert got[5]["text"] == texts[5]  # too short a run
    assert "passage" not in got[6]["text"]
    assert (got[7]["text"], got[8]["text"]) == ("Les.", "Les.")


def test_against_plain_runs(spark):
    """Every run of four lines or more and enough bytes that an earlier text has is gone, but for what no run holds."""
    import random

    rng = random.Random(6)
    pool = [f"This is the common line number {i} of the pool with several words." for i in range(40)]
    texts = []
    for i in range(60):
        lines = [f"Own line {i} {k} with some more words in it." for k in range(rng.randint(1, 6))]
        if rng.random() < 0.6:
            a = rng.randint(0, 30)
            lines[rng.randint(0, len(lines)) : 0] = pool[a : a + rng.randint(1, 9)]
        texts.append("\n".join(lines))
    got = {r["doc_id"]: r["text"].split("\n") for r in dedup_lines(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        lines = t.split("\n")
        kept = [x for x in got[i] if x]
        assert [x for x in lines if x.startswith("Own")] == [x for x in kept if x.startswith("Own")]
        earlier = "\n" + "\n\n".join(texts[:i]) + "\n"
        for j in range(len(lines) - 3):
            run = "\n".join(lines[j : j + 4])
            if len(run) >= 150 and f"\n{run}\n" in earlier:
                assert run not in "\n".join(got[i])
        for x in lines:
            if x in earlier and x not in kept:
                assert x in pool
    assert set(pool) & {x for t in texts for x in t.split("\n")} <= {x for g in got.values() for x in g}


def test_awkward_rows(spark):
    got = dedup_lines(awkward(spark)).collect()
    assert len(got) == 12
    assert {r["text"] for r in got if r["doc_id"] == 4} == {"one two three four five six"}
    assert [r["text"] for r in got if r["doc_id"] == 0] == [None]
    assert dedup_lines(empty(spark)).count() == 0


def test_short_runs_of_enough_bytes_go(spark):
    """Each line of every run of min_bytes or more, be it of one, two or three lines, that an earlier text has is gone; shorter runs stay."""
    import random

    rng = random.Random(7)
    pool = [f"Pool {i} " + "word " * rng.choice((1, 6, 15, 40)) + "end" for i in range(30)]
    texts = []
    for i in range(50):
        a = rng.randint(0, 28)
        texts.append("\n".join([f"Own start {i}", *pool[a : a + rng.randint(1, 3)], f"Own end {i}"]))
    got = {r["doc_id"]: r["text"].split("\n") for r in dedup_lines(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        lines, gone = t.split("\n"), set()
        earlier = "\n" + "\n\n".join(texts[:i]) + "\n"
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = lines[a : b + 1]
                if sum(map(len, run)) >= 150 and "\n" + "\n".join(run) + "\n" in earlier:
                    gone |= {*range(a, b + 1)}
        assert [x for x in got[i] if x] == [x for k, x in enumerate(lines) if k not in gone]
    long = "one sentence that has no end and goes on with many words " * 4
    assert [r["text"] for r in dedup_lines(docs_of(spark, [long + "\nA tail.", long])).orderBy("doc_id").collect()] == [long + "\nA tail.", ""]


def test_texts_that_share_an_id_are_told_apart(spark):
    """Runs of one text aren't cut from others without doc_id or with the same one; a passage at the same place of two is found."""
    for key in (None, 7):
        rows = [(1, PASSAGE), (key, PASSAGE + "\n" + own(1)), (key, own(2, 14)), (key, own(3, 4) + "\n" + own(9, 5)), (key, own(4, 4) + "\n" + own(9, 5))]
        docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        got = [r["text"] for r in dedup_lines(docs).collect()]
        assert sum(own(2, 14) == t for t in got) == 1
        assert sum(own(1) in t for t in got) == 1
        assert sum(own(3, 4) in t for t in got) == sum(own(4, 4) in t for t in got) == 1
        assert sum(own(9, 5) in t for t in got) == 1
        assert sum(PASSAGE in t for t in got) == 1


def test_pieces_of_a_run_in_several_earlier_texts(spark):
    """A run of 12 lines of which earlier texts hold pieces is found whole, whichever text comes first."""
    lines = [f"Line {k} of the run that two texts share." for k in range(12)]
    pieces = ["\n".join([f"Own start {k}.", *lines[k : k + 4], f"Own end {k}."]) for k in (0, 3, 6, 8)]
    texts = [*pieces, *["\n".join([f"Begin {k}.", *lines, f"End {k}."]) for k in (20, 21)]]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs_of(spark, texts)).collect()}
    assert got[5].split() == "Begin 21. End 21.".split()
    assert got[0] == texts[0]


def test_many_short_lines_and_blank_ones(spark):
    """Windows of more lines than are looked at beside each other, blank lines and control characters."""
    verse = [f"w{k}" for k in range(90)]
    texts = ["\n".join(["first of all", *verse]), "\n\n".join([*verse[5:85], "a tail of its own"]), "\x01 head\x02\n" + "\n".join(verse[:80]) + "\nlast\x01"]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs_of(spark, texts)).collect()}
    assert got[0] == texts[0]
    assert got[1].split() == ["a", "tail", "of", "its", "own"]
    assert got[2] == "\x01 head\x02\nlast\x01"


def test_keys_with_many_rows(spark):
    """A passage, and a text, that most rows have: joined apart from the others, with the same result."""
    texts = [own(1000) + "\n" + PASSAGE] + [PASSAGE + f"\nTail {i}." for i in range(60)] + [own(7)] * 60
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs_of(spark, texts)).collect()}
    assert got[0] == texts[0]
    assert all(got[i].strip() == f"Tail {i - 1}." for i in range(1, 61))
    assert [got[i] for i in range(61, 121)] == [own(7)] + [""] * 59


def test_columns_that_clash(spark):
    docs = docs_of(spark, [own(1), own(1)]).selectExpr("*", "'mine' as n_lines", "'t' as t1", "1 as runs")
    got = dedup_lines(docs)
    assert got.columns == [*docs.columns, "_n_lines", "n_removed", "emptied"]
    assert [(r["n_lines"], r["t1"], r["runs"], r["emptied"]) for r in got.orderBy("doc_id").collect()] == [("mine", "t", 1, False), ("mine", "t", 1, True)]
