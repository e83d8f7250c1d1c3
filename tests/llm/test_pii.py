import re

from ledgerspark.llm.pii import replace_entities
from tests.llm.helpers import awkward, docs_of, empty

KEY = "a key"
TEXTS = [
    "Write to Hein.19@mail5.example.com or hein.19@MAIL5.example.com, from 8.196.197.208.", "Card 4539578763621486 or 4539 5787 6362 1486; not 4539578763621487.", "Call +1 (564) 555-4526 today, 078-05-1120 or 415-555-2671.",
    "Frau Petra Müller met Mr. Smith and Mrs Smith. Господин Иванов came.", "Nothing here, 12.5 and 1.2.3.4.5", "hein.19@mail5.example.com 10.0.0.1 10.0.0.2",
]


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)]
    return sum(x if i % 2 else (x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate(d)) % 10


def test_formats_and_coreference(spark):
    got = {r["doc_id"]: (r["text"], r["n_entities"]) for r in replace_entities(docs_of(spark, TEXTS), KEY).collect()}
    mails = re.findall(r"[\w.]+@[\w.]+(?=[ ,])", got[0][0])
    assert mails[0].lower() == mails[1].lower()
    assert mails[0] != mails[1]
    assert got[5][0].split()[0] == mails[0].lower()
    assert "hein" not in got[0][0].lower()
    cards = re.findall(r"\d[\d ]{14,18}\d", got[1][0])
    assert cards[0] == cards[1].replace(" ", "")
    assert [luhn(c) for c in cards] == [luhn(c) for c in re.findall(r"\d[\d ]{14,18}\d", TEXTS[1])]
    assert cards[0] != cards[2]
    assert re.search(r"Call \+1 \(\d{3}\) \d{3}-\d{4} today, \d{3}-\d{2}-\d{4} or \d{3}-\d{3}-\d{4}\.", got[2][0])
    assert not re.search("4526|1120|2671", got[2][0])
    assert re.match(r"Frau [A-Z]\w{3}a [A-Z]\w{4}r met Mr. ([A-Z]\w{3}h) and Mrs [A-Z]\w{3}h. Господин [А-Я][а-я]{4}в came.", got[3][0])
    assert "Smith" not in got[3][0]
    assert got[4] == (TEXTS[4], 0)
    a, b = got[5][0].split()[1:]
    assert a != b
    assert all(0 <= int(x) <= 255 for x in (a + "." + b).split("."))


def test_many_entities_stay_distinct(spark):
    """Every address of a small net is there, so surrogates do meet real ones and are drawn again."""
    texts = [f"10.{i // 64}.{i % 64}.7 {i:03d}-55-0000" for i in range(300)]
    got = replace_entities(docs_of(spark, texts), KEY).collect()
    new = [w for r in got for w in r["text"].split()]
    old = {w for t in texts for w in t.split()}
    assert len(set(new)) == len(new) == 600
    assert not set(new) & old


def test_key_matters(spark):
    docs = docs_of(spark, TEXTS[:1])
    assert replace_entities(docs, "a").first()["text"] != replace_entities(docs, "b").first()["text"]


def test_awkward_rows(spark):
    got = replace_entities(awkward(spark), KEY).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got if r["doc_id"] is not None and r["text"]) == sorted((r["doc_id"], r["text"]) for r in awkward(spark).collect() if r["doc_id"] is not None and r["text"])
    assert replace_entities(empty(spark), KEY).count() == 0


def test_parts_of_a_name_alone(spark):
    """A surname without its title, in the same text, gets the same surrogate; words that hold it, and other texts, stay."""
    texts = ["Mr. Anna Smith came. Smith, they say, is no Smithson; Anna knows. Dr. Smith too.", "Smith is a trade."]
    got = {r["doc_id"]: r["text"] for r in replace_entities(docs_of(spark, texts), KEY).collect()}
    first, last = re.match(r"Mr\. (\w+) (\w+) came", got[0]).groups()
    assert got[0] == f"Mr. {first} {last} came. {last}, they say, is no Smithson; {first} knows. Dr. {last} too."
    assert {first, last}.isdisjoint({"Anna", "Smith"})
    assert got[1] == texts[1]


def test_formats_without_a_free_surrogate(spark):
    """All names of a form are taken, or its letters have no class: placeholders, distinct and the same for equal names."""
    names = [f"Mr {c}o" for c in "BCDFGHJKLMNPQRSTVWXZ"] + ["Mr \u0531\u0561"]
    got = {r["doc_id"]: r["text"] for r in replace_entities(docs_of(spark, [*names, names[0]]), KEY).collect()}
    assert len({got[i] for i in range(len(names))}) == len(names)
    assert not set(got.values()) & set(names)
    assert got[len(names)] == got[0]
    assert got[len(names) - 1].startswith("<name-")


def test_columns_that_clash(spark):
    docs = docs_of(spark, TEXTS).selectExpr("*", "'mine' as n_entities", "'t' as t1")
    got = replace_entities(docs, KEY)
    assert got.columns == [*docs.columns, "_n_entities"]
    assert {(r["n_entities"], r["t1"]) for r in got.collect()} == {("mine", "t")}
