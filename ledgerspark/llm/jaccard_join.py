"""N-gram Jaccard join over count-vector R-trees.

Each document's set of distinct five-word shingles is hashed into groups; the group counts are
a point. For two sets the sum of coordinate minima bounds their overlap from above, so an
R-tree of points, whose nodes keep coordinate maxima, finds all sets that could reach the
similarity; survivors are verified on the sets.

One tree of all points would prune little: random counts differ alike in every direction. So
trees stand on blocks: sets that share a shingle of their prefixes. Shingles have one global
order, rare ones before those that a counting pass found frequent; two sets of similarity t
share a shingle among the first n - ceil(t * n) + 1 of each, so no link is lost, whatever the order.

1. Frequent shingles (a bounded list) are counted over all documents.
2. Map tasks write sets, points and ids to arrays in the shared folder and hand on the sets' keys.
3. Equal sets are one class; from here on one document stands for each.
4. Prefix shingles, read back from the stored sets, are dealt by hash as packed arrays; a task links within each
   block. Pairs must pass bounds of their sizes, of the shared shingle's places in both orders, and of their
   points. Members that are connected already are skipped, so a group of near copies costs about one
   verification for each member. Edges of the task's forest are handed on.
5. Components of the edges by star contraction.

Nothing is gathered on the driver but the frequent list. Links: 100 * intersection >= 80 * union.
Edge cases: texts without words have an empty set and stay alone; fewer than five words are one
shingle; rows of equal doc_id keep their own counts and share components; a row without doc_id has
no component.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import lean, local_path, shared_dir, written
from ledgerspark.llm.components import components
from ledgerspark.llm.lm_scoring import GATHER_TOKENS, gathered, pack, shard_of, summed, texts_in, unpack
from ledgerspark.llm.words import SOLID, mix, shingles_of, words_of

SHINGLE, PERCENT = 5, 80
GROUPS, LEAF, FANOUT, SMALL, FEW = 64, 32, 8, 96, 8
#: The list of frequent shingles: how many, and how often one occurs in a gathered batch to be counted. It only orders.
FREQUENT, OFTEN = 1 << 18, 3


def enough(both: np.ndarray | int, n: int, m: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | bool:
    """Whether an overlap reaches the similarity: 100 * both >= percent * (n + m - both)."""
    return (100 + percent) * both >= percent * (n + m)


class CountVectorRTree:
    """Points bulk-loaded by size and leading coordinates; nodes keep coordinate maxima and the least size."""

    def __init__(self, points: np.ndarray, percent: int = PERCENT) -> None:
        self.percent = percent
        self.sizes = points.sum(axis=1, dtype=np.int64)
        self.order = np.lexsort((points[:, 1], points[:, 0] // 4, (np.log2(np.maximum(self.sizes, 1)) * 8).astype(int)))
        self.points = points[self.order]
        self.own = self.sizes[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
        high, low, top, step = self.points, self.own, self.own, LEAF
        while len(high) > 1:
            heads = np.arange(0, len(high), step)
            high, low, top = np.maximum.reduceat(high, heads), np.minimum.reduceat(low, heads), np.maximum.reduceat(top, heads)
            self.levels.append((high, low, top, step))
            step = FANOUT

    def search(self, point: np.ndarray) -> np.ndarray:
        """Indices of points whose bound reaches the similarity."""
        n = int(point.sum(dtype=np.int64))
        live = np.arange(len(self.levels[-1][0])) if self.levels else np.arange(len(self.points))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low, top, step = self.levels[depth]
            fits = (100 * top[live] >= self.percent * n) & (100 * n >= self.percent * low[live])
            live = live[fits]
            live = live[enough(np.minimum(high[live], point).sum(axis=1, dtype=np.int64), n, low[live], self.percent)]
            below = len(self.levels[depth - 1][0]) if depth else len(self.points)
            live = (live[:, None] * step + np.arange(step)).ravel()
            live = live[live < below]
        live = live[enough(np.minimum(self.points[live], point).sum(axis=1, dtype=np.int64), n, self.own[live], self.percent)]
        return self.order[live]


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The overlap that sets of n and m need."""
    return -(-percent * (n + m) // (100 + percent))


class Store:
    """Sets (ascending hashes), points and ids that map tasks have written, mapped into memory. A place is (part << 32) | row."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def part(self, k: int) -> tuple[np.ndarray, ...]:
        return _part(self.folder, k)

    def set_of(self, place: int) -> np.ndarray:
        sets, ends, _, _ = self.part(place >> 32)
        row = place & 0xFFFFFFFF
        return sets[int(ends[row - 1]) if row else 0 : int(ends[row])]

    def _rows(self, places: np.ndarray, column: int, out: np.ndarray) -> np.ndarray:
        parts = places >> 32
        for k in np.unique(parts):
            own = parts == k
            out[own] = self.part(int(k))[column][places[own] & 0xFFFFFFFF]
        return out

    def points(self, places: np.ndarray) -> np.ndarray:
        return self._rows(places, 2, np.empty((len(places), GROUPS), np.int32))

    def ids(self, places: np.ndarray) -> np.ndarray:
        return self._rows(places, 3, np.empty(len(places), np.int64))


@lru_cache(maxsize=512)
def _part(folder: str, k: int) -> tuple[np.ndarray, ...]:
    def mapped(name: str, kind: type, width: int = 1) -> np.ndarray:
        path = f"{folder}/{name}{k}"
        x = np.asarray(np.memmap(path, kind, "r")) if os.path.getsize(path) else np.empty(0, kind)  # slices of a plain array cost little
        return x.reshape(-1, width) if width > 1 else x

    return mapped("set", np.uint64), mapped("ends", np.int64), mapped("point", np.int32, GROUPS), mapped("id", np.int64)


def _shingles(held: list[pa.RecordBatch], size: int) -> tuple[np.ndarray, np.ndarray]:
    words, offsets = words_of(texts_in(held), SOLID)
    hashes, at = shingles_of(words, offsets, size)
    return mix(hashes), at


def frequent_shingles(docs: DataFrame, size: int, most: int = FREQUENT) -> np.ndarray:
    """Shingles that occur often, the most frequent last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["h", "n"])

        for held in gathered(batches):
            new, n = np.unique(_shingles(held, size)[0], return_counts=True)
            keys, counts = summed(np.concatenate((keys, new[n >= OFTEN])), np.concatenate((counts, n[n >= OFTEN])))
            if len(keys) > GATHER_TOKENS:
                yield out()
                keys, counts = keys[:0], counts[:0]
        yield out()

    counted = docs.select("text").mapInArrow(lean(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "h").limit(most).collect()  # a bounded list
    return np.array([r["h"] for r in reversed(rows)], dtype=np.int64).view(np.uint64)


ROWS = "doc_id long, n long, key_a long, key_b long, place long"


def write_sets(docs: DataFrame, folder: str, size: int) -> DataFrame:
    """ROWS of each document: size and key of its set, its place in the store."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, end = TaskContext.get().partitionId(), 0, 0
        os.makedirs(folder, exist_ok=True)
        names = ("set", "ends", "point", "id")
        temporary = {x: f"{folder}/.{x}{part}.{uuid.uuid4().hex}" for x in names}
        files = {x: open(p, "wb") for x, p in temporary.items()}  # noqa: SIM115
        for held in gathered(batches):
            hashes, at = _shingles(held, size)
            ids = [i for b in held for i in b.column(b.schema.get_field_index("doc_id")).to_pylist()]
            out: list[tuple] = []
            for i, doc_id in enumerate(ids):
                own = np.unique(hashes[at[i] : at[i + 1]])
                n = len(own)
                end += n
                files["set"].write(own.tobytes())
                files["ends"].write(np.int64(end).tobytes())
                files["point"].write(np.bincount((own & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS).astype(np.int32).tobytes())
                files["id"].write(np.int64(-1 if doc_id is None else doc_id).tobytes())
                spread = mix(own)
                a, b = int(spread.sum(dtype=np.uint64)), int(mix(spread ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                out.append((doc_id, n, a - (1 << 64) * (a >> 63), b - (1 << 64) * (b >> 63), (part << 32) | row))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(5)], [x.split()[0] for x in ROWS.split(", ")])
        for x in names:
            files[x].close()
            os.replace(temporary[x], f"{folder}/{x}{part}")

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(lean(run), ROWS)


def prefix_of(own: np.ndarray, known: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The part of a set, first in the global order, of which it shares something with each set of the similarity. known: frequent hashes, ascending, and their rank."""
    n = len(own)
    place = own >> np.uint64(1)
    if len(known) and n:
        j = np.minimum(np.searchsorted(known, own), len(known) - 1)
        often = known[j] == own
        place[often] = np.uint64(1 << 63) + rank[j[often]].astype(np.uint64)
    return own[np.argsort(place, kind="stable")[: n - -(-percent * n // 100) + 1 if n else 0]]


@lru_cache(maxsize=SMALL)
def _triangle(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


class Linker:
    """Links among one task's places: a forest over them, and pairs known to differ. Members are numbered from 0."""

    def __init__(self, store: Store, places: np.ndarray, percent: int) -> None:
        self.store, self.places, self.percent = store, places, percent
        self.points = store.points(places)
        self.sizes = self.points.sum(axis=1, dtype=np.int64)
        self.parent = list(range(len(places)))
        self.edges: list[tuple[int, int]] = []
        self.apart: set[tuple[int, int]] = set()

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def roots(self, members: np.ndarray) -> np.ndarray:
        return np.fromiter(map(self.root, members.tolist()), np.int64, len(members))

    def same(self, x: int, y: int) -> bool:
        a, b = self.store.set_of(int(self.places[x])), self.store.set_of(int(self.places[y]))
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        return bool(enough(int(np.count_nonzero(b[at] == a)), len(a), len(b), self.percent))

    def try_pair(self, x: int, y: int) -> None:
        """Verify two members that aren't connected."""
        pair = (x, y) if x < y else (y, x)
        if pair in self.apart:
            return
        if self.same(x, y):
            self.parent[self.root(x)] = self.root(y)
            self.edges.append(pair)
        else:
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            self.apart.add(pair)

    def bounded(self, x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs' sizes, places i and j of the shared shingle in their orders, and points allow the similarity.

        At the first shingle that two sets share, only what follows it in both can be shared besides; at a
        later one a linked pair may fail, since it has passed at its first.
        """
        n, m = self.sizes[x], self.sizes[y]
        need = least_overlap(n, m, self.percent)
        out = np.flatnonzero((np.minimum(n - i, m - j) >= need) & (np.minimum(n, m) >= need))
        for k in range(0, len(out), 1 << 16):
            part = out[k : k + (1 << 16)]
            both = np.minimum(self.points[x[part]], self.points[y[part]]).sum(axis=1, dtype=np.int64)
            out[k : k + (1 << 16)] = np.where(both >= need[part], part, -1)
        return out[out >= 0]

    def pairs(self, x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        """Verify those of many pairs that the bounds leave and that aren't connected."""
        fit = self.bounded(x, y, i, j)
        for a, b in np.unique(np.stack((np.minimum(x[fit], y[fit]), np.maximum(x[fit], y[fit]))), axis=1).T.tolist():
            if self.root(a) != self.root(b):
                self.try_pair(a, b)

    def small_blocks(self, members: np.ndarray, order: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> None:
        """Blocks of up to FEW members at once; order: places of the shared shingle."""
        for m in range(2, FEW + 1):
            h = heads[sizes == m]
            for k in range(0, len(h), step := 1 << 18):
                part = h[k : k + step]
                at = [(part + a, part + b) for b in range(m) for a in range(b)]
                if len(part):
                    one, two = (np.concatenate(z) for z in zip(*at, strict=True))
                    self.pairs(members[one], members[two], order[one], order[two])

    def block(self, members: np.ndarray, order: np.ndarray) -> None:
        """A larger block: each member outside its largest connected part is searched for in an R-tree of all others."""
        roots = self.roots(members)
        if (roots == roots[0]).all():
            return
        if len(members) <= SMALL:  # one leaf: all points are bounded against each other at once
            i, j = _triangle(len(members))
            apart = np.flatnonzero(roots[i] != roots[j])
            i, j = i[apart], j[apart]
            self.pairs(members[i], members[j], order[i], order[j])
            return
        points, sizes = self.points[members], self.sizes[members]
        tree = CountVectorRTree(points, self.percent)
        done = np.zeros(len(members), bool)
        while True:
            values, index, n = np.unique(roots, return_inverse=True, return_counts=True)
            if len(values) == 1:
                return
            left = np.flatnonzero((index != int(np.argmax(n))) & ~done) if n.max() > 1 else np.flatnonzero(~done)
            for h in left.tolist():
                done[h] = True
                near = tree.search(points[h])
                near = near[(roots[near] != roots[h]) & ~done[near]]
                near = near[np.minimum(sizes[near] - order[near], sizes[h] - order[h]) >= least_overlap(sizes[near], sizes[h], self.percent)]
                before = len(self.edges)
                for y in near.tolist():
                    if self.root(int(members[y])) != self.root(int(members[h])):
                        self.try_pair(int(members[h]), int(members[y]))
                if len(self.edges) > before:
                    break
            else:
                return
            roots = self.roots(members)


def _gathered_prefixes(batches: Iterator[pa.RecordBatch], store: Store, known: np.ndarray, rank: np.ndarray, percent: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Places and their sets' prefixes, GATHER_TOKENS or so at a time."""
    own: list[tuple[int, np.ndarray]] = []
    n = 0
    for batch in batches:
        for place in batch.column(0).to_pylist():
            own.append((place, prefix_of(store.set_of(place), known, rank, percent)))
            n += len(own[-1][1])
            if n > GATHER_TOKENS // 2:
                yield own
                own, n = [], 0
    if own:
        yield own


def link_classes(classes: DataFrame, folder: str, percent: int, frequent: np.ndarray) -> DataFrame:
    """Edges u, v between the documents that stand for the classes. classes: place."""
    ascending = np.argsort(frequent)
    sent = classes.sparkSession.sparkContext.broadcast((frequent[ascending], ascending))  # FREQUENT entries at most
    shards = max(1, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = sent.value
        store = Store(folder)
        for own in _gathered_prefixes(batches, store, known, rank, percent):
            sizes = np.array([len(x) for _, x in own], np.int64)
            tokens = np.concatenate([x for _, x in own])
            places = np.repeat(np.array([p for p, _ in own], np.int64), sizes)
            order = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            shard = shard_of(mix(tokens), shards)
            by_shard = np.argsort(shard, kind="stable")
            bounds = np.searchsorted(shard[by_shard], np.arange(shards + 1))
            some = [s for s in range(shards) if bounds[s] < bounds[s + 1]]
            cut = [by_shard[bounds[s] : bounds[s + 1]] for s in some]
            packed = [pa.array([pack(x[c]) for c in cut], pa.binary()) for x in (tokens, places, order.astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *packed], ["shard", "tokens", "places", "place_in_order"])

    def link(key: tuple, table: pa.Table) -> pa.Table:
        tokens, places, order = (np.concatenate([unpack(x, kind) for x in table.column(c).to_pylist()]) for c, kind in (("tokens", np.uint64), ("places", np.int64), ("place_in_order", np.uint32)))
        by_token = np.lexsort((places, tokens))
        tokens, places, order = tokens[by_token], places[by_token], order[by_token].astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        size = np.diff(np.append(first, len(tokens)))
        store = Store(folder)
        shared = np.repeat(size > 1, size)
        distinct, members = np.unique(places[shared], return_inverse=True)
        order, size = order[shared], size[size > 1]
        heads = np.cumsum(size) - size
        linker = Linker(store, distinct, percent)
        linker.small_blocks(members, order, heads, np.where(size <= FEW, size, 0))
        for a, n in zip(heads[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
            linker.block(members[a : a + n], order[a : a + n])
        ends = distinct[np.array(linker.edges, dtype=np.int64).reshape(-1, 2)] if linker.edges else np.empty((0, 2), np.int64)
        return pa.table({"u": pa.array(store.ids(ends[:, 0])), "v": pa.array(store.ids(ends[:, 1]))})

    dealt = classes.select("place").mapInArrow(lean(deal), "shard int, tokens binary, places binary, place_in_order binary")
    return dealt.groupBy("shard").applyInArrow(link, "u long, v long")


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, class_id (least doc_id with an equal set) and component_id of each document."""
    spark = docs.sparkSession
    folder = local_path(shared_dir(spark)) + "-sets"
    rows = written(write_sets(docs, folder, size), spark)
    full = rows.where("n > 0 and doc_id is not null")
    classes = full.groupBy("key_a", "key_b").agg(F.min(F.struct("doc_id", "place")).alias("one"))
    classes = written(classes.select("key_a", "key_b", F.col("one.doc_id").alias("class_id"), F.col("one.place").alias("place")), spark)
    found = components(link_classes(classes, folder, percent, frequent_shingles(docs, size)))
    named = classes.select("key_a", "key_b", "class_id").join(found.withColumnRenamed("node", "class_id"), "class_id", "left")
    named = named.select("key_a", "key_b", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    out = rows.select("doc_id", "n", "key_a", "key_b").join(named, ["key_a", "key_b"], "left")
    alone = (F.col("n") == 0) | F.col("component_id").isNull()
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
