"""Helpers shared by the text operators: bounded Arrow batches, shared storage, document columns."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; with texts of up to a megabyte a batch stays within some hundred MB.
BATCH_ROWS = 256


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches of whole texts small, so that a worker's memory doesn't follow the row count."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which its worker gives freed memory back: workers stay for later tasks, beside whatever their executor does then."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return task


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI under spark.checkpoint.dir, which driver and executors share.

    The setting is read from the session. Only where it is unset (tests, one machine) a folder
    of the working directory's warehouse is set as the checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + os.path.join(os.path.abspath("spark-warehouse"), "checkpoints")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def local_path(uri: str) -> str:
    """The POSIX path of a shared folder that all machines mount; other schemes can't be mapped into memory."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {uri}")
    return parts.path


def written(df: DataFrame, spark: SparkSession) -> DataFrame:
    """df written once to the shared folder and read back: lineage ends here and executors may be lost."""
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys that hold more than one of so many rows are joined by broadcast; there are HOT of them at most.
HOT = 1024


def meet(rows: DataFrame, keys: DataFrame, on: str, total: int) -> DataFrame:
    """rows joined with keys (one row for each key, n: how many of the `total` rows have it), so that no key gathers in one task."""
    bound = max(total // HOT, 1)
    often = keys.where(F.col("n") > bound)  # HOT rows at most, since their counts add up to total
    is_often = F.col(on).isin([r[0] for r in often.select(on).collect()])
    return rows.where(is_often).join(F.broadcast(often), on).unionByName(rows.where(~is_often).join(keys.where(F.col("n") <= bound), on))


def free_names(taken: Iterable[str], wanted: Iterable[str]) -> dict[str, str]:
    """Names of added columns: as wanted, with underscores in front while a column of the input has the name (case aside)."""
    have, out = {c.lower() for c in taken}, {}
    for name in wanted:
        free = name
        while free.lower() in have:
            free = "_" + free
        out[name] = free
        have.add(free.lower())
    return out


def named(df: DataFrame, within: str | None = None, instead: dict[str, Column] | None = None) -> list[Column]:
    """All columns of df by their exact names, from the struct `within` if given; instead: columns that replace those of a name."""
    ticked = {c: "`" + c.replace("`", "``") + "`" for c in df.columns}
    return [((instead or {})[c] if c in (instead or {}) else F.col(f"{within}.{t}" if within else t)).alias(c) for c, t in ticked.items()]


#: Groups of tasks whose least hashes are merged before the driver merges the groups'.
DEALS = 16


def least_hashed(df: DataFrame, most: int, by: str | None = None, column: str = "text") -> DataFrame:
    """A drawn sample that repeats: by each value of `by`, the rows of the `most` distinct values of column with the least hashes, one row each.

    Tasks hand on their `most` least hashes by value alone, DEALS groups of tasks theirs, so neither copies nor the number of rows
    make it larger, and no value gathers in one task.
    The columns of df, and draw (the hash).
    """
    hashed = df.withColumn("draw", F.xxhash64(column, F.lit(7)))
    if by is None:
        by, hashed = "__all", hashed.withColumn("__all", F.lit(1))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[object, np.ndarray] = {}
        for batch in batches:
            place: dict[object, list[int]] = {}
            for i, k in enumerate(batch.column(0).to_pylist()):
                place.setdefault(k, []).append(i)
            hashes = batch.column(1).to_numpy()
            for k, own in place.items():
                kept[k] = np.unique(np.concatenate((kept[k], hashes[own])) if k in kept else hashes[own])[:most]
        deal = TaskContext.get().partitionId() % DEALS
        for k, v in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(v), kind), pa.array([deal] * len(v), pa.int32()), pa.array(v)], [by, "deal", "draw"])

    def least_of_all(table: pa.Table) -> pa.Table:
        first = np.argsort(table.column("draw").to_numpy(), kind="stable")
        draws, at = np.unique(table.column("draw").to_numpy()[first], return_index=True)
        return table.take(first[at[:most]])

    narrow = hashed.select(by, "draw")
    kind = pa.string() if dict(narrow.dtypes)[by] == "string" else pa.int32()
    schema = f"`{by}` {dict(narrow.dtypes)[by]}, deal int, draw long"
    found = narrow.mapInArrow(lean(least), schema).groupBy(by, "deal").applyInArrow(least_of_all, schema)
    draws: dict[object, set[int]] = {}
    for r in found.collect():  # DEALS times `most` for each value at most
        draws.setdefault(r[by], set()).add(r["draw"])
    limits = {k: sorted(v)[:most][-1] for k, v in draws.items()}
    if not limits:
        return hashed.where("false").drop("__all")
    bound = F.create_map(*[F.lit(x) for k, v in limits.items() for x in (k, v)])[F.col(by)]
    return hashed.where(F.col("draw") <= bound).dropDuplicates([by, "draw"]).drop("__all")
