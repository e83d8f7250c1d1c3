"""Line dedup by winnowing over line hashes, with DataFrame operations alone.

A line ends at a line break or at the space after a sentence's end (one mark; repeated ones, as in ``...`` or ``!!``, end
none); empty lines don't count and go with the line before them. A window is
the fewest lines from a line on that have ``min_bytes`` bytes (150 are some 25 words): a long line alone,
short ones with their neighbours.

1. Winnowing: the minimum of each window (long lines before short ones, then by hash) is a fingerprint. Two texts
   that share a run of min_bytes or more share a whole window of it, and so a fingerprint, however few its lines.
2. Positions of equal fingerprints are joined. Texts with a fingerprint that occurs once only are done.
3. Matches are extended both ways: in texts that are left, the fewest lines onward from each line and
   back from each line that have min_bytes are held against the same spans of all of them. Each line of a shared
   run lies in such a span within the run, so the spans that an earlier place (by doc_id, line) has make
   up the whole run, whichever earlier places hold its pieces.
4. Lines of later repeated spans are deleted.

Equal texts are one class before anything is dealt: only the first text of a class is fingerprinted, and its
later copies are deleted whole if they have min_bytes bytes. Keys with a large part of all rows (HOT at
most, so of bounded size) are joined by broadcast, the others by shuffle: no key gathers in one task.

Edge cases: null and empty texts stay as they are; rows with equal doc_id and text are the same
document and share its decision; rows without doc_id count as the last. Texts are told apart by two hashes,
so different ones of one doc_id, or without any, are different texts, in order of their hashes. A text that
repeats itself keeps its first lines. An empty table gives an empty one. A very long text is exploded into its
lines, which spill. Columns of the input may have any name: added ones that clash get underscores in front (``free_names``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import HOT, free_names, meet, named, written

MIN_BYTES = 150
#: Longer lines count as equally good fingerprints.
LONG_LINE = 64
#: Lines that are looked at beside each other; windows of more lines go by window functions.
AHEAD = 8
#: Places between a line, with what ends it and empty lines, and the next one.
AFTER_ENDS = r"(?:(?<=\n)|(?<=[.!?]\x20)(?<!\.\.\x20|!!\x20|\?\?\x20|\?!\x20|!\?\x20))(?!\n)"
MARKS = ".!?"
_LAST, _HASH = (1 << 63) - 1, (1 << 56) - AHEAD
_TEXT = ("t1", "t2")


def lines_of(text: Column) -> Column:
    """Lines that aren't empty, without what ends them."""
    return F.array_remove(_pieces(text), "")


#: Repeated marks, after which no line ends.
_REPEATED = ("..", "!!", "??", "?!", "!?")


def _pieces(text: Column, end: str = "") -> Column:
    """Lines and empty ones; end: put where a line ends with a space instead of a line break."""
    for marks in _REPEATED:
        text = F.replace(text, F.lit(f"{marks} "), F.lit(f"{marks}\x01"))
    for mark in MARKS:
        text = F.replace(text, F.lit(f"{mark} "), F.lit(f"{mark}{end}\n"))
    return F.split(text, "\n", -1)


def ended_lines(text: Column) -> Column:
    """The same lines with what ends them and empty lines after them, and one more if the text begins with empty lines; joined they are the text again."""
    return F.split(text, AFTER_ENDS, -1)


def _key(text: str) -> dict[str, Column]:
    return {"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(1), F.col(text))}


def _classes(docs: DataFrame) -> DataFrame:
    """Of each distinct text: t1, t2 (its key), doc_id (the first), h (line hashes), w (line bytes), bytes (all), n (documents). docs: doc_id, text."""
    lined = docs.where("text is not null and text <> ''").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), *[c.alias(k) for k, c in _key("text").items()], F.octet_length("text").cast("long").alias("bytes"), _pieces(F.col("text")).alias("pieces"))
    lined = lined.select("doc_id", *_TEXT, (F.col("bytes") - F.size("pieces") + 1).alias("bytes"), F.array_remove("pieces", "").alias("lines"))
    hashed = lined.select("doc_id", *_TEXT, F.transform("lines", lambda x: F.xxhash64(x)).alias("h"), F.transform("lines", lambda x: F.octet_length(x)).alias("w"), "bytes")
    return hashed.groupBy(*_TEXT).agg(F.min(F.struct("doc_id", "h", "w", "bytes")).alias("one"), F.count("*").alias("n")).select(*_TEXT, "one.*", "n")


def _good(h: Column, w: Column) -> Column:
    """Order of lines as fingerprints: long ones first, then by hash; a multiple of AHEAD."""
    return F.shiftleft(F.lit(LONG_LINE) - F.least(w.cast("long"), F.lit(LONG_LINE)), 56).bitwiseOR(h.bitwiseAND(F.lit(_HASH)))


def _neighbours(classes: DataFrame, min_bytes: int, x: str, before: bool = False) -> DataFrame:
    """A row for each line: i (its number), x0.. and w0.. of it and the next AHEAD - 1 lines, before: xp and wp of the one before, more (lines follow these)."""
    enough = classes.where(F.col("bytes") >= max(min_bytes, 1))
    shifted = {f"{c}{j}": F.slice(c, F.lit(j + 1), F.size(c)) if j else F.col(c) for c in (x, "w") for j in range(AHEAD)}
    if before:
        shifted |= {"xp": F.concat(F.array(F.lit(None).cast("long")), F.slice(x, F.lit(1), F.size(x) - 1)), "wp": F.concat(F.array(F.lit(None).cast("int")), F.slice("w", F.lit(1), F.size("w") - 1))}
    zipped = enough.withColumns(shifted).select(*_TEXT, "doc_id", F.size("w").alias("size"), F.posexplode(F.arrays_zip(*shifted)).alias("i", "x"))
    return zipped.select(*_TEXT, "doc_id", "i", (F.col("i") + AHEAD < F.col("size")).alias("more"), "x.*")


def _sums() -> list[Column]:
    """Bytes of a row's first line, first two, and so on; null beyond the text's end."""
    out = [F.col("w0")]
    for j in range(1, AHEAD):
        out.append(out[-1] + F.col(f"w{j}"))
    return out


def _lines(classes: DataFrame, min_bytes: int) -> DataFrame:
    """Rows of lines: i, h, w, c (bytes before) beside t1, t2, doc_id, bytes; dealt by text."""
    dealt = classes.where(F.col("bytes") >= max(min_bytes, 1)).repartition(*_TEXT)
    rows = dealt.select(*_TEXT, "doc_id", "bytes", F.posexplode(F.arrays_zip("h", "w")).alias("i", "x")).select(*_TEXT, "doc_id", "bytes", "i", F.col("x.h").alias("h"), F.col("x.w").cast("long").alias("w"))
    order = Window.partitionBy(*_TEXT).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("c", F.sum("w").over(order) - F.col("w"))


def _minima(classes: DataFrame, min_bytes: int) -> DataFrame:
    """fp (line), place (of text and line) and text of the minimum of each window; fp is null where a window has more than AHEAD lines."""
    rows = _neighbours(classes.withColumn("g", F.zip_with("h", "w", _good)), min_bytes, "g", before=True).drop("doc_id")
    rows = rows.select(*_TEXT, "i", "more", "xp", "wp", *[f"g{j}" for j in range(AHEAD)], *[s.alias(f"s{j}") for j, s in enumerate(_sums())])
    # A window's lines by goodness, then by place; null after its end.
    least = F.least(*[F.when(F.col(f"s{j - 1}") < min_bytes, F.col(f"g{j}") + j) if j else F.col("g0") for j in range(AHEAD)])
    reach = F.greatest(*[F.col(f"s{j}") for j in range(AHEAD)])
    ends = F.array(F.lit(0), *[F.col(f"s{j}") for j in range(AHEAD - 1)])
    rows = rows.select(*_TEXT, "i", "xp", "wp", least.alias("m"), ends.alias("ends"), (reach >= min_bytes).alias("whole"), "more")
    rows = rows.select(*_TEXT, "xp", "wp", "whole", "more", (F.col("m") - F.pmod("m", F.lit(AHEAD))).alias("m"), F.pmod("m", F.lit(AHEAD)).cast("int").alias("j"), "i", "ends")
    # The minimum of the window one line before, unless that has left or a better line has come.
    fresh = F.col("wp").isNull() | (F.col("xp") <= F.col("m")) | (F.col("wp") + F.get("ends", "j") >= min_bytes)
    told = F.when((F.col("whole") & fresh) | (~F.col("whole") & F.col("more")), F.struct(F.when(F.col("whole"), F.col("m")).alias("fp"), F.xxhash64(*_TEXT, F.col("i") + F.col("j")).alias("place")))
    # Not a filter: pushed down it would work all of this out twice, and more often.
    return rows.select(*_TEXT, F.explode_outer(F.array(told)).alias("s")).where("s is not null").select("s.fp", "s.place", *_TEXT)


def _minima_by_windows(classes: DataFrame, min_bytes: int) -> DataFrame:
    """The same for windows of any number of lines."""
    order = Window.partitionBy(*_TEXT).orderBy("c")
    least = F.min(F.struct(_good(F.col("h"), F.col("w")).alias("g"), "i")).over(order.rangeBetween(0, max(min_bytes, 1) - 1))
    windows = _lines(classes, min_bytes).select(*_TEXT, "c", "bytes", least.alias("m")).where(F.col("bytes") - F.col("c") >= min_bytes)
    return windows.select(F.col("m.g").alias("fp"), F.xxhash64(*_TEXT, "m.i").alias("place"), *_TEXT)


def _spans(classes: DataFrame, min_bytes: int) -> DataFrame:
    """fp, t1, t2, doc_id, a, b (first and last line) of the fewest lines of min_bytes onward from each line and back from each line; fp is null where such a span may have more than AHEAD lines."""
    rows = _neighbours(classes, min_bytes, "h")
    rows = rows.select(*_TEXT, "doc_id", "i", "more", "w0", *[f"h{j}" for j in range(AHEAD)], *[x.alias(f"s{j}") for j, x in enumerate(_sums())])
    found = []
    for j in range(AHEAD):
        s = F.col(f"s{j}")
        fewest = ((F.col(f"s{j - 1}") < min_bytes) | (s - F.col("w0") < min_bytes)) if j else F.lit(True)
        found.append(F.when((s >= min_bytes) & fewest, F.struct(F.xxhash64(*[f"h{x}" for x in range(j + 1)]).alias("fp"), (F.col("i") + j).alias("b"))))
    beyond = F.when(F.col("more") & (F.col(f"s{AHEAD - 1}") - F.col("w0") < min_bytes), F.struct(F.lit(None).cast("long").alias("fp"), F.col("i").alias("b")))
    return rows.select(*_TEXT, "doc_id", F.col("i").alias("a"), F.explode_outer(F.array(*found, beyond)).alias("s")).where("s is not null").select("s.fp", *_TEXT, "doc_id", "a", "s.b")


def _spans_by_windows(classes: DataFrame, min_bytes: int) -> DataFrame:
    """The same for spans of any number of lines."""
    min_bytes = max(min_bytes, 1)
    begin = Window.partitionBy(*_TEXT).orderBy("c").rangeBetween(0, min_bytes - 1)
    end = Window.partitionBy(*_TEXT).orderBy("d").rangeBetween(1 - min_bytes, 0)
    lines = _lines(classes, min_bytes).withColumn("d", F.col("c") + F.col("w"))
    on = lines.withColumns({"on": F.collect_list("h").over(begin), "b": F.max("i").over(begin)})
    back = on.withColumns({"back": F.collect_list("h").over(end), "a": F.min("i").over(end), "low": F.min("c").over(end)})
    onward = F.when(F.col("bytes") - F.col("c") >= min_bytes, F.struct(F.xxhash64("on").alias("fp"), F.col("i").alias("a"), F.col("b")))
    backward = F.when(F.col("d") - F.col("low") >= min_bytes, F.struct(F.xxhash64("back").alias("fp"), F.col("a"), F.col("i").alias("b")))
    return back.select(*_TEXT, "doc_id", F.explode(F.array_compact(F.array(onward, backward))).alias("s")).select("s.fp", *_TEXT, "doc_id", "s.a", "s.b")


def _all_of(found: DataFrame, classes: DataFrame, by_windows: Callable[[DataFrame, int], DataFrame], min_bytes: int) -> DataFrame:
    """found, written, and all of the texts where it says that AHEAD lines aren't enough; the same place may come twice."""
    found = written(found, classes.sparkSession)
    finer = classes.join(found.where("fp is null").select(*_TEXT).distinct(), [*_TEXT], "left_semi")
    return found.where("fp is not null").unionByName(written(by_windows(finer, min_bytes), classes.sparkSession))


def repeated_runs(classes: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """t1, t2 and runs (array of a..b) of lines that an earlier place has already. classes: written, since they are read twice."""
    spark = classes.sparkSession
    minima = _all_of(_minima(classes, min_bytes), classes, _minima_by_windows, min_bytes)
    counted = minima.groupBy("fp").agg(F.count("*").alias("n"), F.min("place").alias("p"), F.max("place").alias("q")).where("p <> q").select("fp", "n")
    texts = meet(minima, written(counted, spark), "fp", minima.count()).select(*_TEXT).distinct()
    matched = written(classes.join(texts, [*_TEXT], "left_semi"), spark)
    prints = _all_of(_spans(matched, min_bytes), matched, _spans_by_windows, min_bytes)
    place = F.struct("doc_id", *_TEXT, "a")
    firsts = prints.groupBy("fp").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    met = meet(prints, written(firsts, spark), "fp", prints.count()).where(place != F.col("first"))
    # Overlapping spans of a text become one run.
    own = Window.partitionBy(*_TEXT).orderBy("a", "b")
    reach = F.max("b").over(own.rowsBetween(Window.unboundedPreceding, -1))
    opened = met.select(*_TEXT, "a", "b").withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("a")).cast("int"))
    merged = opened.withColumn("part", F.sum("new").over(own)).groupBy(*_TEXT, "part").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return merged.groupBy(*_TEXT).agg(F.collect_list(F.struct("a", "b")).alias("runs"))  # a text's own runs


def dedup_lines(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """docs with text cut, and n_lines, n_removed (lines), emptied (nothing is left of a text that had something)."""
    spark = docs.sparkSession
    classes = written(_classes(docs.select("doc_id", "text")), spark)
    plan = classes.select(*_TEXT, F.col("doc_id").alias("first"), F.size("h").alias("lines"), (F.col("bytes") >= min_bytes).alias("long"), "n")
    row = docs.select(F.struct(*named(docs)).alias("r")).withColumns(_key("r.text"))
    is_later = F.coalesce((F.coalesce(F.col("r.doc_id").cast("long"), F.lit(_LAST)) != F.col("first")) & F.col("long"), F.lit(False))
    # Copies of texts with a large part of all rows are known without a shuffle.
    total = classes.agg(F.sum("n")).first()[0] or 0
    often = F.broadcast(plan.where(F.col("n") > F.greatest(F.lit(total / HOT), F.lit(1))).drop("n"))
    copies = row.join(often, [*_TEXT]).where(is_later).withColumn("runs", F.lit(None).cast("array<struct<a: int, b: int>>"))
    others = row.join(often.withColumnsRenamed({"first": "f", "long": "l", "lines": "s"}), [*_TEXT], "left").where(~F.coalesce((F.coalesce(F.col("r.doc_id").cast("long"), F.lit(_LAST)) != F.col("f")) & F.col("l"), F.lit(False))).drop("f", "l", "s")
    planned = plan.drop("n").join(repeated_runs(classes, min_bytes), [*_TEXT], "left")
    joined = others.join(planned, [*_TEXT], "left").unionByName(copies)

    text, later = F.col("r.text"), is_later
    whole = F.coalesce(text, F.lit(""))
    cut = F.col("runs").isNotNull() & ~later

    def kept(lines: Column, number: Column | int) -> Column:
        return F.filter(lines, lambda _, i: ~F.exists("runs", lambda r: (i - number >= r["a"]) & (i - number <= r["b"])))

    # Without empty lines and control characters the lines that are left join again as they were cut.
    plain = ~(whole.contains("\n\n") | whole.startswith("\n") | whole.contains("\x01") | whole.contains("\x02"))
    quick = F.array_join(kept(_pieces(whole, "\x02"), 0), "\n")
    for mark, was in (("\x02\n", " "), ("\x02", " "), ("\x01", " ")):
        quick = F.replace(quick, F.lit(mark), F.lit(was))
    less = F.when(plain, quick).otherwise(F.array_join(kept(ended_lines(whole), whole.startswith("\n").cast("int")), ""))
    n_lines = F.when(whole == "", 0).otherwise(F.coalesce("lines", F.lit(0))).cast("long")
    gone = F.aggregate("runs", F.lit(0), lambda a, r: a + r["b"] - r["a"] + 1)
    left = F.when(later, 0).when(cut, n_lines - gone).otherwise(n_lines).cast("long")
    out = joined.select("r", F.when(later, F.lit("")).when(cut, less).otherwise(text).alias("cut"), n_lines.alias("n"), left.alias("left"))
    names = free_names(docs.columns, ("n_lines", "n_removed", "emptied"))
    emptied = ~F.coalesce("cut", F.lit("")).rlike(r"\S") & (F.col("n") > F.col("left"))
    return out.select(*named(docs, "r", {"text": F.col("cut")}), F.col("n").alias(names["n_lines"]), (F.col("n") - F.col("left")).alias(names["n_removed"]), emptied.alias(names["emptied"]))
