"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import written


def _tally(edges: DataFrame) -> tuple[int, int]:
    n, s = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
    return n, s or 0


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long), in any direction. Gives node, component (its least node) for all nodes but the least ones.

    Every step is a minimum by key and a join with it, so that no node's neighbours are gathered;
    each round is written to the shared folder, which cuts the lineage.
    """
    spark = edges.sparkSession
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = written(pairs, spark)
    seen = _tally(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("low"))
        after = large.join(small, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = written(after, spark)
        if (tally := _tally(now)) == seen:
            break
        seen = tally
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
