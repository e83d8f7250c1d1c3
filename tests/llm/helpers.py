"""Small tables that hold every awkward case, and plain versions of shared rules."""

import re

from pyspark.sql import functions as F

LOWER = {i: i + 32 for i in range(65, 91)}
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def solid_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def docs_of(spark, texts, langs=None):
    """Documents by text; with a column that clashes with results' names."""
    rows = [(i, t, (langs or {}).get(i), "src0", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DDL).withColumns({"spans": F.lit("x"), "score": F.lit(1), "n_words": F.lit(2)})


def awkward(spark):
    """Null, empty, white space, one word, a repeated row, a null id, a very long word, other scripts."""
    texts = [None, "", "  \n\t ", "word", "one two three four five six", "é" * 5000, "long " * 3000, "Привет мир. Как дела?", "a\x00b \x1c c", "😀 text"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(4, texts[4], None, None, None), (None, "no id here at all today", None, None, None)]
    return spark.createDataFrame(rows, DDL)


def empty(spark):
    return spark.createDataFrame([], DDL)
