"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of hashed byte n-grams (2 to 4) of its lower-cased letters,
words apart; each language has several centroids (spherical k-means over a bounded
sample: as many distinct texts of each language, those with the least hashes, so that copies weigh nothing and
a fit repeats exactly); the language of the most similar centroid by cosine is predicted.
Document frequencies cover all training documents. A text is rejected when its similarity is
below what the sample shows for texts of its length, with a margin, so that only text unlike
every language goes. Texts without a letter, and null, are ``und`` and rejected.

Edge cases: no labelled text at all, or an empty table, makes everything ``und``; null labels never train; ties
between centroids go to the first language by name; repeated rows get equal results; very long texts are counted
whole, in pieces cut between words; only text (and lang, for training rows) is read, other columns of any name are
carried, and results whose names they have get underscores in front (``free_names``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from ledgerspark.llm.common import free_names, lean, least_hashed, named
from ledgerspark.llm.words import pieces

#: n of the n-grams and the bits of their hash space.
GRAMS = ((2, 11), (3, 13), (4, 13))
SIZE = sum(1 << b for _, b in GRAMS)
CENTROIDS = 4
#: Texts that the centroids are fitted on, over all languages.
SAMPLE = 4000
#: The floor of a length: this part of the sample's low quantile, and never above CEILING.
MARGIN, CEILING, LOWEST_SHARE, BINS = 0.4, 0.2, 0.01, 24
UNKNOWN = "und"

_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[: ord("a")] = 32
_LETTER[ord("z") + 1 : 128] = 32
_IN_WORD = _LETTER != 32


def _piece_counts(raw: np.ndarray, into: np.ndarray) -> None:
    data = np.concatenate(([np.uint8(32)], _LETTER[raw], [np.uint8(32)]))
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)  # runs of other bytes are one
    data = data[keep].astype(np.uint32)
    at = 0
    for n, bits in GRAMS:
        if len(data) >= n:
            code = np.zeros(len(data) - n + 1, np.uint32)
            for j in range(n):
                code = (code << np.uint32(8)) | data[j : j + len(code)]
            code = (code * np.uint32(2654435761)) >> np.uint32(32 - bits)
            into[at : at + (1 << bits)] += np.bincount(code, minlength=1 << bits)
        at += 1 << bits


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a whole text that occur, ascending, and how often."""
    into = np.zeros(SIZE, np.int64)
    for piece in pieces(text.lower().encode(), _IN_WORD):
        _piece_counts(np.frombuffer(piece, np.uint8), into)
    at = np.flatnonzero(into)
    return at, into[at]


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # SIZE x (languages * CENTROIDS)
    owner: np.ndarray
    floors: np.ndarray  # least similarity by bin of length

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        at, n = gram_counts(text)
        v = (1 + np.log(n)) * self.idf[at]
        norm = np.sqrt((v * v).sum())
        return at, (v / norm if norm else v), int(n.sum())

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine similarity, rejected."""
        if not self.languages or not any(map(str.isalpha, text or "")):
            return UNKNOWN, 0.0, True
        at, v, n = self.vector(text)
        cos = v @ self.centroids[at]
        best = int(np.argmax(cos))
        score = float(min(1.0, max(0.0, cos[best])))
        return self.languages[self.owner[best]], score, score < self.floors[length_bin(n)]


def length_bin(n: int) -> int:
    return min(BINS - 1, int(np.log2(n + 1)))


Rows = list[tuple[np.ndarray, np.ndarray]]
#: Rows of one dense block in k-means.
BLOCK = 256


def _blocks(rows: Rows) -> Iterator[tuple[int, np.ndarray]]:
    """Sparse rows as dense blocks of bounded size, with the number of each one's first row."""
    for i in range(0, len(rows), BLOCK):
        part = rows[i : i + BLOCK]
        dense = np.zeros((len(part), SIZE), np.float32)
        for j, (at, v) in enumerate(part):
            dense[j, at] = v
        yield i, dense


def k_means(rows: Rows, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from farthest-first seeds over sparse rows; fewer rows than k give fewer centroids."""
    k = min(k, len(rows))

    def dense(i: int) -> np.ndarray:
        out = np.zeros(SIZE, np.float32)
        out[rows[i][0]] = rows[i][1]
        return out

    def near(c: np.ndarray) -> np.ndarray:
        return np.array([v @ c[at] for at, v in rows])

    centres = [dense(0)]
    far = near(centres[0])
    for _ in range(k - 1):
        centres.append(dense(int(np.argmin(far))))
        far = np.maximum(far, near(centres[-1]))
    now = np.stack(centres)
    for _ in range(rounds):
        new, size = np.zeros_like(now), np.zeros(k, np.int64)
        for _, block in _blocks(rows):
            who = np.argmax(block @ now.T, axis=1)
            for j in range(k):
                new[j] += block[who == j].sum(axis=0)
                size[j] += (who == j).sum()
        new = np.where(size[:, None] > 0, new, now)
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, now):
            break
        now = new
    return now


def _frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many training texts each hashed n-gram occurs, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                at, _ = gram_counts(text)
                total[at] += 1
                n += 1
        if n:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n), pa.int64())], ["gram", "n"])

    counted = train.select("text").mapInArrow(lean(run), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out, docs = np.zeros(SIZE, np.int64), 0
    for gram, n in counted.collect():  # SIZE + 1 rows at most
        if gram < 0:
            docs = n
        else:
            out[gram] = n
    return out, docs


def fit(labelled: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """labelled: text and lang of the training documents. sample: bound on texts the centroids are fitted on."""
    labelled = labelled.select("text", "lang").where("text is not null and lang is not null")
    languages = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())  # a row for each language
    if not languages:
        return LanguageModel([], np.zeros(SIZE), np.zeros((SIZE, 0)), np.zeros(0, int), np.zeros(BINS))
    df, n_docs = _frequencies(labelled)
    idf = np.log((n_docs + 1) / (df + 1)) + 1
    drawn = least_hashed(labelled, max(1, sample // len(languages)), "lang").select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [gram_counts(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([x[0].astype(np.uint16).tobytes() for x in found], pa.binary()), pa.array([x[1].astype(np.int32).tobytes() for x in found], pa.binary())],
                ["lang", "at", "n"],
            )

    rows = drawn.mapInArrow(lean(run), "lang string, at binary, n binary").collect()  # `sample` rows at most
    rows.sort(key=lambda r: (r["lang"], r["at"], r["n"]))
    parts, owner, texts = [], [], []
    for i, lang in enumerate(languages):
        own = []
        for r in rows:
            if r["lang"] == lang:
                at, n = np.frombuffer(r["at"], np.uint16), np.frombuffer(r["n"], np.int32)
                v = (1 + np.log(n)) * idf[at]
                norm = np.sqrt((v * v).sum())
                own.append((at, (v / norm if norm else v).astype(np.float32)))
                texts.append((*own[-1], int(n.sum())))
        if own:
            centres = k_means(own, CENTROIDS)
            parts.append(centres)
            owner += [i] * len(centres)
    if not parts:
        return LanguageModel([], idf, np.zeros((SIZE, 0)), np.zeros(0, int), np.zeros(BINS))
    centroids = np.ascontiguousarray(np.concatenate(parts).T, dtype=np.float32)
    seen: list[list[float]] = [[] for _ in range(BINS)]
    for at, v, n in texts:
        seen[length_bin(n)].append(float((v @ centroids[at]).max()))
    floors, last = np.zeros(BINS), 0.0
    for b in range(BINS):  # bins that the sample hardly has take the floor of the next shorter ones
        if len(seen[b]) >= 20:
            last = min(CEILING, MARGIN * float(np.quantile(seen[b], LOWEST_SHARE)))
        floors[b] = last
    return LanguageModel(languages, idf, centroids, np.array(owner), floors)


def identify(docs: DataFrame, model: LanguageModel, keep: bool = False) -> DataFrame:
    """lang_pred, score and rejected per document; keep: all columns of docs, without them the doc_id."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # some MB, whatever the input
    carried = docs if keep else docs.select("doc_id")
    held = docs.select(F.struct(*named(carried)).alias("r"), *([] if keep else ["text"]))  # the text goes out once
    schema = StructType([held.schema["r"], *[StructField(c, t) for c, t in (("lang_pred", StringType()), ("score", DoubleType()), ("rejected", BooleanType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = batch.column(0).field("text") if keep else batch.column(1)
            out = [model.predict(t) for t in texts.to_pylist()]
            columns = [batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["r", "lang_pred", "score", "rejected"])

    names = free_names(carried.columns, ("lang_pred", "score", "rejected"))
    return held.mapInArrow(lean(run), schema).select(*named(carried, "r"), *[F.col(k).alias(v) for k, v in names.items()])


#: Folds by which documents are held out of the fit.
FOLDS, HELD_OUT = 4, 2


def held_out(folds: int = FOLDS) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == HELD_OUT, F.lit(False))


def train_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out())
