"""Benchmark decontamination with an FM-index for each training shard.

Each task gathers documents into shards of bounded size. A shard's words become symbols of the
benchmark's vocabulary; other words end a run (no phrase can cross them), and runs shorter
than the shortest phrase hold nothing to find. The runs' suffixes are sorted, their
Burrows-Wheeler transform is kept as a wavelet tree, and all test phrases are searched
backward at once through its ranks. Rows found are located by walking to sampled suffix
positions, and the occurrences are merged into removal spans.

Phrases are the windows of WINDOW consecutive item words; an item of fewer words is one
window. Documents are never shuffled. The benchmark is sent in blocks of at most
``block_chars`` characters, one written pass over the documents for each.

Edge cases: null texts and texts without words have no words and are never contaminated;
items without words have no window; repeated rows give repeated results; an item without id
counts as ``null``; an empty benchmark leaves everything clean; very long texts are searched whole, as a shard of
their own; ties can't arise; an empty table gives an empty one. Columns of docs may have any name: added ones that
clash get underscores in front (``free_names``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import free_names, lean, named, written
from ledgerspark.llm.words import ALNUM, words_of

#: Fixed by the contract.
WINDOW, SHARE = 13, 20
SHARD_BYTES, SAMPLE_RATE, BLOCK_CHARS = 8 << 20, 16, 16 << 20


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling; a 0 ends a run and differs from every other 0, the first being the least."""
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    k = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-k] = rank[k:] + 1 if k < n else 0
        key = rank * (int(rank.max()) + 2 if n else 1) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank, k = new, 2 * k
        if n == 0 or rank[order[-1]] == n - 1 or k >= n:
            return order


class WaveletTree:
    """Ranks of symbols in a sequence, level by level from the highest bit."""

    def __init__(self, sequence: np.ndarray, bits: int) -> None:
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(bits - 1, -1, -1):
            one = (sequence >> bit) & 1
            ones = np.concatenate(([0], np.cumsum(one, dtype=np.int32)))
            self.levels.append((bit, ones, len(sequence) - int(ones[-1])))
            sequence = np.concatenate((sequence[one == 0], sequence[one == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its end."""
        begin = np.zeros_like(end)
        for bit, ones, zeros in self.levels:
            up = ((symbol >> bit) & 1).astype(bool)
            a, b = ones[begin], ones[end]
            begin = np.where(up, zeros + a, begin - a)
            end = np.where(up, zeros + b, end - b)
        return end - begin


class FmIndex:
    def __init__(self, symbols: np.ndarray, size: int, rate: int = SAMPLE_RATE) -> None:
        """symbols: runs of 1..size, each after and before a 0."""
        order = suffix_array(symbols)
        self.last = symbols[order - 1]  # the symbol before each suffix
        self.tree = WaveletTree(self.last, max(1, int(size).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=size + 1))))
        sampled = (order % rate == 0) | (self.last == 0)  # a walk never leaves its run
        self.sampled, self.before = sampled, np.concatenate(([0], np.cumsum(sampled)))
        self.positions = order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of all phrases (rows of symbols, filled up with anything)."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.last), np.int64)
        for back in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (high > low))
            if not len(live):
                continue
            c = phrases[live, lengths[live] - back]
            low[live] = self.first[c] + self.tree.rank(c, low[live])
            high[live] = self.first[c] + self.tree.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of index rows."""
        out = np.empty(len(rows), np.int64)
        left, rows, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(left):
            done = self.sampled[rows]
            out[left[done]] = self.positions[self.before[rows[done]]] + steps
            left, rows = left[~done], rows[~done]
            c = self.last[rows].astype(np.int64)
            rows = self.first[c] + self.tree.rank(c, rows)
            steps += 1
        return out


@dataclass
class Phrases:
    """Distinct windows of benchmark items, over the sorted hashes of their words."""

    words: np.ndarray
    windows: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]

    @staticmethod
    def of(rows: list[tuple[str, str]], window: int = WINDOW) -> Phrases:
        hashes, offsets = words_of([t.encode() for _, t in rows], ALNUM)
        vocabulary, symbols = np.unique(hashes, return_inverse=True)
        found: dict[bytes, set[str]] = {}
        for i, (item, _) in enumerate(rows):
            own = (symbols[offsets[i] : offsets[i + 1]] + 1).astype(np.int64)
            for j in range(max(1, len(own) - window + 1) if len(own) else 0):
                found.setdefault(own[j : j + window].tobytes(), set()).add(item)
        windows = np.zeros((len(found), window), np.int64)
        lengths = np.zeros(len(found), np.int64)
        for i, w in enumerate(found):
            own = np.frombuffer(w, np.int64)
            windows[i, : len(own)], lengths[i] = own, len(own)
        return Phrases(vocabulary, windows, lengths, [sorted(x) for x in found.values()])


def occurrences(texts: list[bytes | None], phrases: Phrases) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """Of one shard: words of each text, merged spans of hit words, items found."""
    hashes, offsets = words_of(texts, ALNUM)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    n_words = np.diff(offsets)
    if not len(phrases.windows) or not len(hashes):
        return n_words, spans, items
    at = np.minimum(np.searchsorted(phrases.words, hashes), len(phrases.words) - 1)
    symbols = np.where(phrases.words[at] == hashes, at + 1, 0)
    known = symbols > 0
    begins = np.zeros(len(symbols) + 1, bool)
    begins[offsets] = True
    starts = np.flatnonzero(known & (begins[:-1] | ~np.concatenate(([False], known[:-1]))))
    ends = np.flatnonzero(known & (begins[1:] | ~np.concatenate((known[1:], [False])))) + 1
    runs = np.flatnonzero(ends - starts >= phrases.lengths.min())
    if not len(runs):
        return n_words, spans, items
    starts, sizes = starts[runs], (ends - starts)[runs]
    place = np.concatenate(([0], np.cumsum(sizes + 1)))  # of each run in the index text, after its leading 0
    source = np.repeat(starts - place[:-1] - 1, sizes + 1) + np.arange(place[-1]) + 0
    text = np.zeros(place[-1] + 1, np.int64)
    inner = np.ones(place[-1], bool)
    inner[place[:-1]] = False
    text[:-1][inner] = symbols[source[inner]]
    index = FmIndex(text, len(phrases.words))
    low, high = index.search(phrases.windows, phrases.lengths)
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    first = source[index.locate(rows)]
    change = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + phrases.lengths[which], -1)
    hit = np.concatenate(([False], np.cumsum(change[:-1]) > 0, [False]))
    cut = np.zeros(len(symbols) + 1, bool)
    cut[offsets] = True
    begin = np.flatnonzero(hit[1:-1] & (~hit[:-2] | cut[:-1]))
    end = np.flatnonzero(hit[1:-1] & (~hit[2:] | cut[1:])) + 1
    for a, b, d in zip(begin.tolist(), end.tolist(), (np.searchsorted(offsets, begin, "right") - 1).tolist(), strict=True):
        spans[d].append((a - int(offsets[d]), b - int(offsets[d])))
    pairs = np.unique((np.searchsorted(offsets, first, "right") - 1) * len(n) + which)
    for d, w in zip((pairs // len(n)).tolist(), (pairs % len(n)).tolist(), strict=True):
        items[d].update(phrases.items[w])
    return n_words, spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


#: Added columns.
RESULTS = ("n_words", "n_hit", "items", "spans", "contaminated")
_PLACES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _mark(held: DataFrame, phrases: Phrases, shard_bytes: int) -> DataFrame:
    """held: r (a row of documents), and n_words, spans, items of the blocks before, to which this one's are added."""
    sent = held.sparkSession.sparkContext.broadcast(phrases)  # at most block_chars characters' worth
    names = held.columns

    def shard(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for b in batches for t in b.column(0).field("text").cast(pa.binary()).to_pylist()]
        n_words, spans, items = occurrences(texts, sent.value)
        at = 0
        for b in batches:
            part = slice(at, at + b.num_rows)
            at += b.num_rows
            s = [_merged(x + [(y["start"], y["end"]) for y in old or ()]) for x, old in zip(spans[part], b.column(2).to_pylist(), strict=True)]
            i = [sorted({*x, *(old or ())}) for x, old in zip(items[part], b.column(3).to_pylist(), strict=True)]
            columns = [pa.array(n_words[part], pa.int64()), pa.array([[{"start": x, "end": y} for x, y in z] for z in s], _PLACES), pa.array(i, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.nbytes for b in waiting) >= shard_bytes:
                yield from shard(waiting)
                waiting = []
        if waiting:
            yield from shard(waiting)

    return held.mapInArrow(lean(run), held.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs with n_words, n_hit, items (found, sorted as strings), spans (of words to remove, merged) and contaminated.

    More than one block of the benchmark: each is written before the next, so that a worker holds one at a time.
    """
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text")).where("text is not null")
    size = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    nothing = {"n_words": "bigint", "spans": "array<struct<start: bigint, end: bigint>>", "items": "array<string>"}
    out = docs.select(F.struct(*named(docs)).alias("r"), *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    for k in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else bench
        out = _mark(out, Phrases.of([(r[0], r[1]) for r in part.collect()], window), shard_bytes)
        out = written(out, docs.sparkSession) if k + 1 < blocks else out
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    told = {"n_words": F.col("n_words"), "n_hit": F.col("n_hit"), "items": F.col("items"), "spans": F.col("spans"), "contaminated": (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))}
    names = free_names(docs.columns, RESULTS)
    return out.withColumn("n_hit", n_hit).select(*named(docs, "r"), *[told[k].alias(v) for k, v in names.items()])


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "spans",
    )
