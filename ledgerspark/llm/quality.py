"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on each document (good, bad, no vote). Votes are counted by
pattern over all documents - at most 3^labellers patterns, whatever the input - and
expectation-maximisation on these counts estimates each labeller's rates of votes for good and bad
documents. The posterior of a document's pattern is its soft label. Posterior labels of
a bounded sample (the distinct texts of least hashes, so that copies weigh nothing and a fit repeats exactly)
train a linear scorer on hashed words and word shapes, which then scores every whole text. Toxicity is a second
head of the same kind, on word presence: it is trained on a bounded sample of documents with toxicity labels (least
hashes of doc_id), and words of the abuse list count in any case.

Edge cases: null counts as empty; empty texts get votes like any other and no features; very long texts are read
whole; an empty table gives an empty result; repeated rows give repeated results; ties of votes follow the prior; of
labels that differ the toxic one holds. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import least_hashed
from ledgerspark.llm.words import ALNUM, SOLID, words_of

GOOD, BAD, NONE = 1, 0, 2
BITS, WORD_BITS = 15, 19
#: Documents that the scorer is trained on, and labelled rows for the toxicity head.
SAMPLE, TOXIC_SAMPLE = 5000, 20_000
ROUNDS, EPOCHS, STEP, L2 = 100, 150, 2.0, 1e-6
#: Kept from this quality on; toxic from this score on.
KEEP, TOXIC = 0.4, 0.9
#: Words of abuse, English.
ABUSE = (
    "idiot idiots moron morons stupid trash scum loser losers clown clowns pathetic worthless disgusting imbecile dumbass "
    "bastard bastards bitch bitches asshole assholes fuck fucking fucked shit shitty cunt whore slut retard retarded vermin"
).split()
_SYMBOLS = "#$%&*|<>{}[]\\^~=+@"


@dataclass
class Facts:
    """Counts of one whole text that the labellers look at, and the hashes of its words and token shapes."""

    n: int
    most: int  # of the most frequent word
    upper: int
    letters: int
    symbols: int
    ends: int
    abuse: int
    lines: int
    repeated_lines: int
    words: np.ndarray
    shapes: np.ndarray


#: Classes of bytes in a token's shape: u upper case, x other letters, 0 digits; marks stand for themselves.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = ord("u"), ord("x"), ord("x"), ord("0")
_CLASS[9:14] = 32
_END = re.compile(r"[.!?][\"')]*$")
_ABUSE = np.sort(words_of([w.encode() for w in ABUSE], ALNUM)[0])


def _shape(data: bytes) -> bytes:
    """Token shapes of a text, runs of one class as one."""
    x = _CLASS[np.frombuffer(data, np.uint8)]
    return x[np.concatenate(([True], x[1:] != x[:-1]))].tobytes() if len(x) else b""


def _flags(shape: bytes) -> int:
    text = shape.decode("ascii", "replace")
    core = text.strip(".,;:!?\"'()")
    return (core == "u") + 2 * (core in ("x", "u", "ux")) + 4 * any(s in text for s in _SYMBOLS) + 8 * bool(_END.search(text))


def facts_of_all(texts: list[str | None]) -> list[Facts]:
    raws = [(t or "").encode() for t in texts]
    shapes = [_shape(r) for r in raws]
    distinct = sorted({x for s in shapes for x in s.split()})
    keys = words_of(distinct, SOLID)[0]
    order = np.argsort(keys)
    keys, flags = keys[order], np.array([_flags(x) for x in distinct], np.int64)[order]
    sh, so = words_of(shapes, SOLID)
    wh, wo = words_of(raws, ALNUM)
    own = flags[np.searchsorted(keys, sh)] if len(sh) else np.zeros(0, np.int64)

    def per_text(hit: np.ndarray, offsets: np.ndarray) -> list[int]:
        return np.diff(np.concatenate(([0], np.cumsum(hit)))[offsets]).tolist()

    sums = [per_text((own & k) > 0, so) for k in (1, 2, 4, 8)]
    abuse = per_text(_ABUSE[np.minimum(np.searchsorted(_ABUSE, wh), len(_ABUSE) - 1)] == wh, wo)
    out = []
    for i, t in enumerate(texts):
        w = wh[wo[i] : wo[i + 1]]
        lines = [x for x in (t or "").split("\n") if x.strip()]
        most = int(np.unique(w, return_counts=True)[1].max()) if len(w) else 0
        out.append(Facts(int(so[i + 1] - so[i]), most, *(x[i] for x in sums), abuse[i], len(lines), len(lines) - len(set(lines)), w, sh[so[i] : so[i + 1]]))
    return out


def _between(x: float, low: float, high: float) -> int:
    """Good below, bad above, no vote between."""
    return GOOD if x <= low else BAD if x >= high else NONE


#: name -> vote. Bounds are usual ones of web-text filters.
LABELLERS = {
    "length": lambda f: BAD if not f.n else GOOD if f.n >= 50 else NONE,
    "symbols": lambda f: _between(f.symbols / f.n, 0.05, 0.2) if f.n else BAD,
    "shouting": lambda f: _between(f.upper / f.n, 0.1, 0.4) if f.n else NONE,
    "letters": lambda f: BAD if f.n and f.letters / f.n < 0.5 else GOOD if f.n and f.letters / f.n > 0.8 else NONE,
    "repetition": lambda f: NONE if f.n < 20 else BAD if f.most / f.n > 0.3 else GOOD if f.most / f.n < 0.15 else NONE,
    "sentences": lambda f: NONE if f.n < 10 else GOOD if 0.02 <= f.ends / f.n <= 0.35 else BAD,
    "lines": lambda f: NONE if f.lines < 3 else _between(f.repeated_lines / f.lines, 0.1, 0.3),
    "abuse": lambda f: BAD if f.abuse else NONE,
}
NAMES = tuple(LABELLERS)


def votes_of(f: Facts) -> str:
    return "".join(str(v(f)) for v in LABELLERS.values())


@dataclass
class LabelModel:
    prior: float  # of good
    rates: np.ndarray  # labeller x (bad, good document) x (bad, good vote)

    def posterior(self, votes: str) -> float:
        """Probability of good."""
        logit = np.log(self.prior) - np.log1p(-self.prior)
        for j, v in enumerate(votes):
            if v == str(NONE):  # says nothing
                continue
            logit += np.log(self.rates[j, 1, int(v)]) - np.log(self.rates[j, 0, int(v)])
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """By labeller, how often its votes on bad and on good documents are right."""
        r = self.rates
        return {k: (float(r[j, 0, BAD] / (r[j, 0, BAD] + r[j, 0, GOOD])), float(r[j, 1, GOOD] / (r[j, 1, BAD] + r[j, 1, GOOD]))) for j, k in enumerate(NAMES)}


def estimate(counts: dict[str, int], rounds: int = ROUNDS) -> LabelModel:
    """EM from the start that a bad vote outweighs good ones; smoothing by pseudo-counts."""
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    votes = np.array([[int(v) for v in p] for p in patterns]).reshape(len(patterns), len(NAMES))
    good = np.where((votes == BAD).any(axis=1), 0.1, 0.95) if len(patterns) else np.empty(0)
    model = LabelModel(0.5, np.full((len(NAMES), 2, 2), 0.5))
    for _ in range(rounds):
        weight = np.stack([n * (1 - good), n * good])
        prior = float(np.clip((weight[1].sum() + 2) / (n.sum() + 4), 0.02, 0.98))
        rates = np.empty_like(model.rates)
        for v in (BAD, GOOD):
            rates[:, :, v] = (weight @ (votes == v)).T + 1.0
        rates /= rates.sum(axis=2, keepdims=True)
        # A labeller is better than chance: its bad votes are likelier on bad documents.
        rates[:, 1, BAD] = np.minimum(rates[:, 0, BAD], rates[:, 1, BAD])
        rates[:, 1, GOOD] = 1 - rates[:, 1, BAD]
        model = LabelModel(prior, rates)
        new = np.array([model.posterior(p) for p in patterns])
        if len(new) == 0 or np.abs(new - good).max() < 1e-9:
            break
        good = new
    return model


def features_of(f: Facts) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and their weights: shares of words and shapes, damped, of length one."""
    if not f.n:
        return np.zeros(0, np.int64), np.zeros(0)
    half = np.uint64(64 - (BITS - 1))
    idx = np.concatenate((f.words >> half, (f.shapes >> half) + np.uint64(1 << (BITS - 1)))).astype(np.int64)
    sums = np.bincount(idx, minlength=1 << BITS)
    at = np.flatnonzero(sums)
    v = np.sqrt(sums[at])
    return at, v / np.linalg.norm(v)


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, idx: np.ndarray, v: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[idx] @ v + self.bias, -30, 30))))


def words_in(f: Facts) -> tuple[np.ndarray, np.ndarray]:
    """Hashed distinct words, with equal weights."""
    idx = np.unique(f.words >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    return idx, np.ones(len(idx))


def train(rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, bits: int = BITS, step: float = STEP) -> Scorer:
    """Logistic regression on soft labels by full-batch steps with momentum, classes balanced."""
    w, b = np.zeros(1 << bits), 0.0
    if not rows:
        return Scorer(w, b)
    idx = np.concatenate([r[0] for r in rows])
    val = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    share = np.clip(targets.mean(), 0.02, 0.98)
    weight = targets * 0.5 / share + (1 - targets) * 0.5 / (1 - share)
    gw, gb = np.zeros_like(w), 0.0
    for _ in range(EPOCHS):
        z = np.bincount(row, val * w[idx], minlength=len(rows)) + b
        err = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - targets) / len(rows)
        gw = 0.9 * gw + np.bincount(idx, val * err[row], minlength=len(w)) + L2 * w
        gb = 0.9 * gb + err.sum()
        w -= step * gw
        b -= step * gb
    return Scorer(w, float(b))


@dataclass
class Model:
    labels: LabelModel
    scorer: Scorer
    toxic: Scorer | None = None

    def is_toxic(self, f: Facts) -> bool:
        return f.abuse > 0 or (self.toxic is not None and self.toxic.score(*words_in(f)) >= TOXIC)


def fit_toxic(docs: DataFrame, labels: DataFrame, sample: int = TOXIC_SAMPLE) -> Scorer | None:
    """The toxicity head, from `sample` labelled documents at most, one row each."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = least_hashed(marked, sample, column="doc_id").select("doc_id", "toxic")  # `sample` rows at most
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "toxic")).alias("one")).select("one.text", "one.toxic")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words_in(f)[0] for f in facts_of_all(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32).tobytes() for x in found], pa.binary()), batch.column(1)], ["at", "toxic"])

    rows = known.mapInArrow(featured, "at binary, toxic int").collect()  # `sample` rows at most
    rows.sort()
    targets = np.array([float(r["toxic"] > 0) for r in rows])
    if not rows or targets.min() == targets.max():
        return None
    return train([(x := np.frombuffer(r["at"], np.int32), np.ones(len(x))) for r in rows], targets, WORD_BITS, 0.1)


def fit(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE) -> Model:
    """Label model over all documents, scorer on `sample` distinct texts at most. labels: doc_id, toxic of some documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            seen.update(map(votes_of, facts_of_all(batch.column(0).to_pylist())))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["votes", "n"])

    texts = docs.select("text")
    counts = {r["votes"]: r["n"] for r in texts.mapInArrow(count, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()}  # 3^8 rows at most
    weak = estimate(counts)
    drawn = least_hashed(texts.select(F.coalesce("text", F.lit("")).alias("text")), sample).select("text")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts = facts_of_all(batch.column(0).to_pylist())
            found = [features_of(f) for f in facts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([votes_of(f) for f in facts]), pa.array([x[0].astype(np.uint16).tobytes() for x in found], pa.binary()), pa.array([x[1].astype(np.float32).tobytes() for x in found], pa.binary())],
                ["votes", "at", "v"],
            )

    rows = drawn.mapInArrow(featured, "votes string, at binary, v binary").collect()  # `sample` rows at most
    rows.sort(key=lambda r: (r["votes"], r["at"], r["v"]))
    targets = np.array([weak.posterior(r["votes"]) for r in rows])
    scorer = train([(np.frombuffer(r["at"], np.uint16).astype(np.int32), np.frombuffer(r["v"], np.float32).astype(float)) for r in rows], targets)
    return Model(weak, scorer, fit_toxic(docs, labels) if labels is not None else None)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, quality (0 to 1), label_posterior, votes, toxic and keep of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = sent.value, {}
        for batch in batches:
            out = []
            for f in facts_of_all(batch.column(1).to_pylist()):
                votes = votes_of(f)
                if votes not in known:
                    known[votes] = model.labels.posterior(votes)
                out.append((model.scorer.score(*features_of(f)), known[votes], votes, model.is_toxic(f)))
            quality = [x[0] for x in out]
            columns = [pa.array(quality), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.string()), pa.array([x[3] for x in out], pa.bool_()), pa.array([x[0] >= KEEP and not x[3] for x in out], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "quality", "label_posterior", "votes", "toxic", "keep"])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, "doc_id long, quality double, label_posterior double, votes string, toxic boolean, keep boolean")
