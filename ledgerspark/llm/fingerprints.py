"""Document fingerprints: threshold-scaled sketches of word shingles.

A text's sketch retains every hash of its distinct five-word shingles that lies below a fixed
fraction of the hash space. Sketches of parts merge by union, and containment and Jaccard
similarity are estimated from retained hashes alone, however unequal the texts. The
fingerprint string is ``<digest of the folded word sequence>:<hex hashes>``; the digest decides likeness
where neither text retained a hash (equal 1, else 0).

Words are runs of characters other than ASCII white space, A-Z lower-cased; a text of fewer
than five words is one shingle; null counts as empty and has no shingle. Equal texts have
equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.words import SOLID, mix, shingles_of, words_of

SHINGLE = 5
#: One hash of so many is retained.
SCALE = 8
#: Blocks of neighbouring doc_ids for each partition, rows of a block at least, and blocks at most (rows are streamed, so blocks may be of any size).
BLOCKS_EACH, LEAST_ROWS, MOST_BLOCKS = 8, 64, 1024


class Sketch:
    """Retained hashes (ascending) and the digest of a text's words."""

    __slots__ = ("digest", "hashes")

    def __init__(self, hashes: np.ndarray, digest: int) -> None:
        self.hashes, self.digest = hashes, digest

    def merge(self, other: Sketch) -> Sketch:
        """The sketch of both texts' shingles together."""
        return Sketch(np.union1d(self.hashes, other.hashes), self.digest ^ other.digest if self.digest != other.digest else self.digest)

    def likeness(self, other: Sketch) -> float:
        """Estimated Jaccard similarity."""
        both = len(np.intersect1d(self.hashes, other.hashes, assume_unique=True))
        most = len(self.hashes) + len(other.hashes) - both
        return both / most if most else float(self.digest == other.digest)

    def containment(self, other: Sketch) -> float:
        """Estimated part of this text's shingles that the other has."""
        if not len(self.hashes):
            return float(self.digest == other.digest)
        return len(np.intersect1d(self.hashes, other.hashes, assume_unique=True)) / len(self.hashes)

    def __str__(self) -> str:
        return f"{self.digest:016x}:{self.hashes.astype('>u8').tobytes().hex()}"

    @staticmethod
    def parse(text: str) -> Sketch:
        digest, hashes = text.split(":")
        return Sketch(np.frombuffer(bytes.fromhex(hashes), ">u8").astype(np.uint64), int(digest, 16))


def sketches(texts: list[bytes], scale: int = SCALE) -> list[Sketch]:
    words, offsets = words_of(texts, SOLID)
    hashes, at = shingles_of(words, offsets, SHINGLE)
    hashes = mix(hashes + np.uint64(1))
    limit = np.uint64(((1 << 64) - 1) // scale)
    out = []
    for i in range(len(texts)):
        own = hashes[at[i] : at[i + 1]]
        seq = words[offsets[i] : offsets[i + 1]]
        place = mix(seq + np.arange(len(seq), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        digest = int(place.sum(dtype=np.uint64)) if len(seq) else 0
        out.append(Sketch(np.unique(own[own < limit]), digest))
    return out


def in_blocks(docs: DataFrame, parts: int, least_rows: int = LEAST_ROWS) -> DataFrame:
    """doc_id, text in blocks of neighbouring doc_ids by one shuffle of the texts.

    Bounds between blocks are quantiles of doc_id. Each block, in descending order, also gets
    the first row of the block that follows it (the last block that of the first), so that every
    row finds its next one within its block. Columns: block, ahead (the extra row), doc_id, text.
    """
    n = docs.count()
    cuts = max(1, min(parts * BLOCKS_EACH, n // least_rows, MOST_BLOCKS))
    spread = [i / cuts for i in range(1, cuts)]
    cut = sorted(set(docs.select(F.percentile_approx("doc_id", spread, max(10_000, 10 * cuts))).first()[0] or [])) if spread else []
    # Block 0 has the largest ids.
    bounds = F.array(*[F.lit(int(c)).cast("long") for c in cut]) if cut else F.expr("cast(array() as array<bigint>)")
    below = F.aggregate(bounds, F.lit(0), lambda a, c: a + (c >= F.col("doc_id")).cast("int")) if cut else F.lit(0)
    placed = docs.withColumn("block", F.when(F.col("doc_id").isNull(), F.lit(len(cut))).otherwise(below))
    firsts = {r["block"]: r["top"] for r in placed.groupBy("block").agg(F.max("doc_id").alias("top")).collect()}  # a row per block
    order = sorted(firsts)
    before = {order[i]: order[i - 1] for i in range(len(order))}  # the first block's row goes to the last one
    tops = [(firsts[b], before[b]) for b in order]
    pairs = F.create_map(*[F.lit(x) for top, b in tops if top is not None for x in (int(top), b)]) if any(t is not None for t, _ in tops) else None
    target = pairs[F.col("doc_id")] if pairs is not None else F.lit(None).cast("int")
    if None in [t for t, _ in tops]:  # a block of nulls alone
        target = F.when(F.col("doc_id").isNull(), F.lit(next(b for t, b in tops if t is None))).otherwise(target)
    places = F.array_compact(F.array(F.struct(F.col("block"), F.lit(False).alias("ahead")), F.when(target.isNotNull(), F.struct(target.alias("block"), F.lit(True).alias("ahead")))))
    return placed.select("doc_id", "text", F.explode(places).alias("p")).select("p.block", "p.ahead", "doc_id", "text")


def with_edits(docs: DataFrame, scale: int = SCALE, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Fingerprints of each text and of its edited text, and likeness to the edited and the next text.

    The edited text has its last floor(n / 2) code points replaced by as many first ones (or all)
    of the next document by descending doc_id; the first follows the last. Rows of equal doc_id
    are taken by text; rows without doc_id come last.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double"
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = in_blocks(docs.select(docs["doc_id"].cast("long"), "text"), parts, least_rows).repartition(parts, "block").sortWithinPartitions("block", "ahead", F.desc_nulls_last("doc_id"), F.asc_nulls_first("text"))

    def emit(rows: list[tuple[int | None, str, str]]) -> Iterator[pa.RecordBatch]:
        """rows: doc_id, text, next text."""
        texts = [t for _, t, _ in rows]
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for _, t, n in rows]
        step = 64
        for i in range(0, len(rows), step):
            part = range(i, min(i + step, len(rows)))
            own = sketches([texts[j].encode() for j in part], scale)
            new = sketches([edited[j].encode() for j in part], scale)
            nxt = [*own[1:], sketches([rows[part[-1]][2].encode()], scale)[0]]
            out = [
                (rows[j][0], len(texts[j]), hashlib.sha256(edited[j].encode()).hexdigest(), str(a), str(b), a.likeness(b), a.likeness(c), a.containment(b))
                for j, a, b, c in zip(part, own, new, nxt, strict=True)
            ]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row before, whose next text isn't known yet
        done = False  # an extra row of this block has closed it
        for batch in batches:
            ready = []
            for block, ahead, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                text = text or ""
                if held is not None and held[0] == block and not done:
                    ready.append((held[1], held[2], text))
                if held is None or held[0] != block:
                    done = False
                if ahead:
                    held, done = (block, None, ""), True
                else:
                    held = (block, doc_id, text)
            if ready:
                yield from emit(ready)

    return dealt.mapInArrow(run, schema)
