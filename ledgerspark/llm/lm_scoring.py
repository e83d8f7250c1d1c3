"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted arrays, memory-mapped by workers.

1. Words are counted: each task adds up hashes in memory and hands on one packed array per
   shard of the hash space; a shard's task sums them and writes a sorted hash array with its
   counts. The place in these arrays is a word's number.
2. Bigrams are counted alike, as 64-bit keys of two word numbers, dealt by a hash of the key,
   so that no frequent word gathers in one task. A shard's keys are written sorted: keys seen
   once, and keys seen more often with their counts.
3. The same shards hand on, by word, what contexts and continuations need; these arrays are
   written in the order of the words.

Workers map the arrays into memory and look words and bigrams up by binary search. The files
lie in the shared folder of spark.checkpoint.dir (mounted on all machines), are written under
another name and renamed, and depend on the input alone, so a lost executor's tasks can run
again. What is gathered follows the number of distinct bigrams.

Tokens are words (runs without ASCII white space, A-Z lower-cased) and one end per document.
Edge cases: null texts are empty and score their end alone; without any training document the
model is uniform over one unknown word; rows without doc_id train and aren't held out.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import local_path, shared_dir
from ledgerspark.llm.words import SOLID, mix, words_of

BEGIN, END = np.uint64(0x5BE6170000000001), np.uint64(0xE4D0000000000002)
#: Bytes of text and tokens that a task holds at once.
GATHER_BYTES, GATHER_TOKENS = 4 << 20, 3_000_000
FOLDS, HELD_OUT = 7, 2


def held_out(folds: int = FOLDS) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == HELD_OUT, F.lit(False))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Even ranges of the hash space, in order."""
    return ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def tokens_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with each text's end, and offsets."""
    words, offsets = words_of(texts, SOLID)
    return np.insert(words, offsets[1:], END), offsets + np.arange(len(offsets))


def previous(tokens: np.ndarray, offsets: np.ndarray, begin: np.generic) -> np.ndarray:
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[offsets[:-1]] = begin
    return out


def gathered(batches: Iterator[pa.RecordBatch], limit: int = GATHER_BYTES) -> Iterator[list[pa.RecordBatch]]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= limit:
            yield held
            held = []
    if held:
        yield held


def texts_in(held: list[pa.RecordBatch], name: str = "text") -> list[bytes | None]:
    return [t for b in held for t in b.column(b.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys ascending, and the sums of each value."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values)


def pack(x: np.ndarray) -> bytes:
    """Bytes plane by plane, which the shuffle's compression likes; ascending values as differences."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def pack_keys(keys: np.ndarray) -> tuple[bytes, bytes]:
    high = (keys >> np.uint64(32)).astype(np.uint32)
    return pack(np.diff(high, prepend=np.uint32(0))), pack(keys.astype(np.uint32))


def unpack_keys(high: bytes, low: bytes) -> np.ndarray:
    return (np.cumsum(unpack(high, np.uint32), dtype=np.uint64) << np.uint64(32)) | unpack(low, np.uint32)


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as all of them fit in."""
    return counts.astype(np.uint32) if counts.max(initial=0) < 1 << 32 else counts


def save(folder: str, name: str, x: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, x)
    os.replace(part, f"{folder}/{name}.npy")


@lru_cache(maxsize=4096)
def load(folder: str, name: str) -> np.ndarray:
    return np.load(f"{folder}/{name}.npy", mmap_mode="r")


@dataclass
class Model:
    """Where the arrays lie, and the few numbers of the whole corpus."""

    folder: str
    shards: int
    offsets: list[int] = field(default_factory=list)  # number of the first word of each shard, and all
    tokens: int = 0
    types: int = 0  # distinct training tokens
    bigrams: int = 0
    low: tuple[float, float, float] = (0.0, 0.0, 0.0)  # discounts of continuation counts 1, 2, more
    high: tuple[float, float, float] = (0.0, 0.0, 0.0)
    gamma: float = 1.0  # what is left for unknown words

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 for unknown ones. hashes ascending."""
        out = np.full(len(hashes), -1, np.int64)
        bounds = np.searchsorted(shard_of(hashes, self.shards), np.arange(self.shards + 1))
        for s in range(self.shards):
            a, b = bounds[s], bounds[s + 1]
            if a < b and self.offsets[s + 1] > self.offsets[s]:
                keys = load(self.folder, f"word{s}")
                at = np.minimum(np.searchsorted(keys, hashes[a:b]), len(keys) - 1)
                out[a:b] = np.where(keys[at] == hashes[a:b], at + self.offsets[s], -1)
        return out

    def of_words(self, name: str, numbers: np.ndarray) -> np.ndarray:
        """Values of words by ascending numbers."""
        out = np.zeros(len(numbers), np.int64)
        bounds = np.searchsorted(numbers, self.offsets)
        for s in range(self.shards):
            a, b = bounds[s], bounds[s + 1]
            if a < b:
                out[a:b] = load(self.folder, f"{name}{s}")[numbers[a:b] - self.offsets[s]]
        return out

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of bigrams."""
        shard = shard_of(mix(keys), self.shards)
        order = np.lexsort((keys, shard))
        bounds = np.searchsorted(shard[order], np.arange(self.shards + 1))
        out = np.zeros(len(keys), np.int64)
        for s in range(self.shards):
            own = order[bounds[s] : bounds[s + 1]]
            if not len(own):
                continue
            for name, values in (("once", None), ("more", "n")):
                if os.path.exists(f"{self.folder}/{name}{s}.npy") and len(there := load(self.folder, f"{name}{s}")):
                    at = np.minimum(np.searchsorted(there, keys[own]), len(there) - 1)
                    same = there[at] == keys[own]
                    out[own[same]] = load(self.folder, f"{values}{s}")[at[same]] if values else 1
        return out


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2 and more, from how many have counts 1 to 4; half where these can't tell."""
    if min(n) <= 0:
        return 0.5, 0.75, 1.0
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.05), k + 0.95) for k in range(3))


def _ways(n: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3, 4."""
    return np.array([(n == k).sum() for k in (1, 2, 3, 4)])


def train(docs: DataFrame, folder: str | None = None, shards: int | None = None) -> Model:
    """docs: text of the training documents."""
    spark = docs.sparkSession
    shards = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = folder or local_path(shared_dir(spark)) + "-kn"
    model = Model(folder, shards)
    texts = docs.select("text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.array([BEGIN, END]), np.zeros(2, np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            bounds = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
            own = [s for s in range(shards) if bounds[s] < bounds[s + 1]]
            cut = [slice(bounds[s], bounds[s + 1]) for s in own]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([keys[c].tobytes() for c in cut], pa.binary()), pa.array([pack(counts[c]) for c in cut], pa.binary())], ["shard", "keys", "counts"])

        for held in gathered(batches):
            tokens, _ = tokens_of(texts_in(held))
            new, n = np.unique(tokens, return_counts=True)
            keys, counts = summed(np.concatenate((keys, new)), np.concatenate((counts, n)))
            if len(keys) > GATHER_TOKENS:
                yield from out()
                keys, counts = keys[:0], counts[:0]
        yield from out()

    def write_words(key: tuple, table: pa.Table) -> pa.Table:
        s = key[0].as_py()
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()])
        counts = np.concatenate([unpack(x, np.int64) for x in table.column("counts").to_pylist()])
        keys, counts = summed(keys, counts)
        save(folder, f"word{s}", keys)
        save(folder, f"count{s}", counts)
        return pa.table({"shard": pa.array([s], pa.int32()), "types": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64())})

    told = texts.mapInArrow(words, "shard int, keys binary, counts binary").groupBy("shard").applyInArrow(write_words, "shard int, types long, tokens long").collect()  # a row per shard
    sizes = {r["shard"]: r["types"] for r in told}
    model.offsets = np.concatenate(([0], np.cumsum([sizes.get(s, 0) for s in range(shards)]))).tolist()
    model.tokens = sum(r["tokens"] for r in told)
    if not model.tokens:
        return model
    model.types = model.offsets[-1] - 1  # without the beginning
    if model.offsets[-1] >= 1 << 32:
        raise ValueError("more than 2^32 distinct words")

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = np.uint64(model.numbers(np.array([BEGIN]))[0])
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            shard = shard_of(mix(keys), shards)
            order = np.argsort(shard, kind="stable")
            bounds = np.searchsorted(shard[order], np.arange(shards + 1))
            for s in range(shards):
                if bounds[s] < bounds[s + 1]:
                    own = order[bounds[s] : bounds[s + 1]]
                    k, n = keys[own], counts[own]
                    more = np.flatnonzero(n > 1)
                    packed = [*pack_keys(k), pack(more.astype(np.uint32)), pack(n[more])]
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], ["shard", "high", "low", "more", "counts"])

        waiting: list[np.ndarray] = []
        for held in gathered(batches):
            tokens, offsets = tokens_of(texts_in(held))
            distinct, back = np.unique(tokens, return_inverse=True)
            numbers = model.numbers(distinct).astype(np.uint64)[back]
            waiting.append((previous(numbers, offsets, begin) << np.uint64(32)) | numbers)
            if sum(map(len, waiting)) > GATHER_TOKENS // 2:
                new, n = np.unique(np.concatenate(waiting), return_counts=True)
                keys, counts = summed(np.concatenate((keys, new)), np.concatenate((counts, n)))
                waiting = []
                if len(keys) > GATHER_TOKENS:
                    yield from out()
                    keys, counts = keys[:0], counts[:0]
        if waiting:
            new, n = np.unique(np.concatenate(waiting), return_counts=True)
            keys, counts = summed(np.concatenate((keys, new)), np.concatenate((counts, n)))
        yield from out()

    offsets = np.array(model.offsets, dtype=np.int64)
    stats = "shard int, kind string, ids binary, a binary, b binary, c binary, d binary"
    names = [x.split()[0] for x in stats.split(", ")]

    def write_bigrams(key: tuple, table: pa.Table) -> pa.Table:
        s = key[0].as_py()
        all_keys, all_counts = [], []
        for high, low, more, n in zip(*(table.column(c).to_pylist() for c in ("high", "low", "more", "counts")), strict=True):
            k = unpack_keys(high, low)
            c = np.ones(len(k), np.int64)
            c[unpack(more, np.uint32)] = unpack(n, np.int64)
            all_keys.append(k)
            all_counts.append(c)
        keys, counts = summed(np.concatenate(all_keys), np.concatenate(all_counts))
        once = counts == 1
        save(folder, f"once{s}", keys[once])
        save(folder, f"more{s}", keys[~once])
        save(folder, f"n{s}", narrow(counts[~once]))
        rows: list[tuple] = [(-1, "n", b"", _ways(counts).astype(np.int64).tobytes(), np.int64(len(keys)).tobytes(), b"", b"")]
        left, right = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        u, c, n1, n2, n3 = summed(left, counts, once.astype(np.int64), (counts == 2).astype(np.int64), (counts > 2).astype(np.int64))
        w, cont = summed(right, np.ones(len(right), np.int64))
        for kind, ids, values in (("u", u, (c, n1, n2, n3)), ("w", w, (cont,))):
            bounds = np.searchsorted(ids, offsets)
            for t in range(shards):
                if bounds[t] < bounds[t + 1]:
                    cut = slice(bounds[t], bounds[t + 1])
                    own = (ids[cut] - offsets[t]).astype(np.uint32)
                    packed = [pack(v[cut].astype(np.int64)) for v in values] + [b""] * (4 - len(values))
                    rows.append((t, kind, pack(np.diff(own, prepend=np.uint32(0))), *packed))
        kinds = [pa.int32(), pa.string(), *[pa.binary()] * 5]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    def write_contexts(key: tuple, table: pa.Table) -> pa.Table:
        s = key[0].as_py()
        total = np.zeros(5, np.int64)
        if s >= 0:
            size = int(offsets[s + 1] - offsets[s])
            out = {k: np.zeros(size, np.int64) for k in ("ctx", "one", "two", "many", "cont")}
            for row in table.to_pylist():
                ids = np.cumsum(unpack(row["ids"], np.uint32), dtype=np.int64)
                for k, f in zip(("ctx", "one", "two", "many") if row["kind"] == "u" else ("cont",), "abcd", strict=False):
                    out[k][ids] += unpack(row[f], np.int64)
            for k, v in out.items():
                save(folder, f"{k}{s}", narrow(v))
            total[:4], total[4] = _ways(out["cont"]), (out["cont"] > 2).sum()
        else:
            for row in table.to_pylist():
                total[:4] += np.frombuffer(row["a"], np.int64)
                total[4] += np.frombuffer(row["b"], np.int64)[0]
        return pa.table({"shard": pa.array([s], pa.int32()), "n": pa.array([total.tolist()], pa.list_(pa.int64()))})

    counted = texts.mapInArrow(bigrams, "shard int, high binary, low binary, more binary, counts binary").groupBy("shard").applyInArrow(write_bigrams, stats)
    told = counted.groupBy("shard").applyInArrow(write_contexts, "shard int, n array<long>").collect()  # a row per shard
    high = np.sum([r["n"] for r in told if r["shard"] < 0], axis=0)
    low = np.sum([r["n"] for r in told if r["shard"] >= 0], axis=0)
    model.bigrams = int(high[4])
    model.high, model.low = _discounts(high[:4].tolist()), _discounts(low[:4].tolist())
    model.gamma = float(np.dot(model.low, [low[0], low[1], low[4]])) / model.bigrams
    return model


def _less(counts: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *discounts])[np.minimum(counts, 3)], 0.0)


def score_texts(model: Model, texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """n_tokens, n_known, base_score and score of each text."""
    tokens, offsets = tokens_of(texts)
    distinct, back = np.unique(tokens, return_inverse=True)
    known = np.full(len(distinct), -1, np.int64)
    counts, cont = np.zeros((2, len(distinct)), np.int64)
    if model.tokens:
        known = model.numbers(distinct)
        there = np.flatnonzero(known >= 0)
        counts[there], cont[there] = model.of_words("count", known[there]), model.of_words("cont", known[there])
    base = np.log10((counts + 1) / (model.tokens + model.types + 1))
    uniform = 1 / (model.types + 1)
    lower = _less(cont, model.low) / max(model.bigrams, 1) + model.gamma * uniform
    prob = lower[back]
    if model.tokens:
        begin = model.numbers(np.array([BEGIN]))[0]
        now = known[back]
        before = previous(now, offsets, begin)
        contexts, where = np.unique(before, return_inverse=True)
        stat = {k: np.zeros(len(contexts), np.int64) for k in ("ctx", "one", "two", "many")}
        real = np.flatnonzero(contexts >= 0)
        for k, v in stat.items():
            v[real] = model.of_words(k, contexts[real])
        total = np.maximum(stat["ctx"], 1)
        left = np.where(stat["ctx"] > 0, (model.high[0] * stat["one"] + model.high[1] * stat["two"] + model.high[2] * stat["many"]) / total, 1.0)
        prob = prob * left[where]
        pairs = np.flatnonzero((now >= 0) & (before >= 0))
        keys, again = np.unique((before[pairs].astype(np.uint64) << np.uint64(32)) | now[pairs].astype(np.uint64), return_inverse=True)
        prob[pairs] += _less(model.counts(keys), model.high)[again] / total[where[pairs]]
    heads = offsets[:-1]
    return {
        "n_tokens": np.diff(offsets),
        "n_known": np.add.reduceat((counts > 0).astype(np.int64)[back], heads),
        "base_score": np.add.reduceat(base[back], heads),
        "score": np.add.reduceat(np.log10(prob), heads),
    }


def perplexity(score: F.Column, n_tokens: F.Column) -> F.Column:
    return F.pow(F.lit(10.0), -score / n_tokens)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score, perplexity of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in gathered(batches):
            found = score_texts(model, texts_in(held))
            ids = pa.concat_arrays([b.column(0) for b in held])
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(found[k]) for k in ("n_tokens", "n_known", "base_score", "score"))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    scored = docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("perplexity", perplexity(F.col("score"), F.col("n_tokens")))
