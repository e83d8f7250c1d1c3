"""Profile scores, alerts and vector similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stat_scores(metrics: DataFrame) -> DataFrame:
    """metrics: profile_id, category, value, target (null: none), weight. Score of each category, at most 100."""
    near = F.greatest(1 - F.abs(F.col("value") - F.col("target")) / F.col("target"), F.lit(0.0)) * F.col("weight")
    points = F.when(F.col("target").isNull(), F.col("weight")).when(F.col("target") > 0, near)
    bad = F.when((F.col("weight") < 0) | (F.col("target") <= 0), F.lit("InvalidInput"))
    out = metrics.groupBy("profile_id", "category").agg(F.sum(points).alias("s"), F.max(bad).alias("error_code"))
    return out.select("profile_id", "category", F.when(F.col("error_code").isNull(), F.round(F.least("s", F.lit(1.0)) * 100, 6)).alias("score"), "error_code")


def stat_alerts(metrics: DataFrame, warning: float, critical: float, trend: float) -> DataFrame:
    """Distance from target and change since the last measurement: profile_id, metric_idx, kind, severity, pct, message."""
    off = F.when(F.col("target") > 0, F.abs(F.col("value") - F.col("target")) / F.col("target") * 100)
    now, before = F.try_element_at("history", F.lit(-1)), F.try_element_at("history", F.lit(-2))
    change = F.when(before.isNotNull() & now.isNotNull(), F.when(before == 0, F.lit(100.0)).otherwise(F.try_divide(F.abs(now - before), F.abs(before)) * 100))
    x = metrics.withColumns({"__off": off, "__change": change})
    aims = F.when(F.col("__off") >= critical, F.lit("Critical")).when(F.col("__off") >= warning, F.lit("Warning"))
    told = [
        F.when(aims.isNotNull(), F.struct(F.lit("target").alias("kind"), aims.alias("severity"), F.col("__off").alias("pct"), F.format_string("%s is %.1f%% away from target %.1f", "name", "__off", "target").alias("message"))),
        F.when(F.col("__change") >= trend, F.struct(F.lit("trend").alias("kind"), F.lit("Warning").alias("severity"), F.col("__change").alias("pct"), F.format_string("%s changed by %.1f%% from last measurement", "name", "__change").alias("message"))),
    ]
    return x.select("profile_id", "metric_idx", F.explode(F.array_compact(F.array(*told))).alias("a")).select("profile_id", "metric_idx", "a.kind", "a.severity", F.round("a.pct", 6).alias("pct"), "a.message")


def _both(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, 1, n), F.slice(b, 1, n)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def euclidean(a: Column, b: Column) -> Column:
    """Distance over the common length; null if that is none."""
    x, y = _both(a, b)
    return F.when(F.size(x) > 0, F.sqrt(_sum(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null for empty or zero vectors."""
    x, y = _both(a, b)
    norms = F.sqrt(_sum(F.transform(x, lambda v: v * v))) * F.sqrt(_sum(F.transform(y, lambda v: v * v)))
    return F.when(F.size(x) > 0, F.try_divide(_sum(F.zip_with(x, y, lambda p, q: p * q)), norms))


def pearson(a: Column, b: Column) -> Column:
    """Correlation; null for empty or constant vectors."""
    x, y = _both(a, b)
    n = F.size(x)
    mx, my = F.try_divide(_sum(x), n), F.try_divide(_sum(y), n)
    cov = _sum(F.zip_with(x, y, lambda p, q: (p - mx) * (q - my)))
    var = _sum(F.transform(x, lambda v: (v - mx) * (v - mx))) * _sum(F.transform(y, lambda v: (v - my) * (v - my)))
    return F.when(n > 0, F.try_divide(cov, F.sqrt(var)))


METRICS = {"Euclidean": euclidean, "Cosine": cosine, "Pearson": pearson}


def similarity(pairs: DataFrame, metric: str) -> DataFrame:
    """pairs: a_id, b_id, a, b (arrays of double)."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {sorted(METRICS)}")
    value = METRICS[metric](F.col("a"), F.col("b"))
    return pairs.select("a_id", "b_id", F.round(value, 6).alias("score"), F.when(value.isNull(), F.lit("InvalidInput")).alias("error_code"))


def tax_targets(rules: DataFrame) -> DataFrame:
    """Target of the effective tax rate by profile: all its rules' rates, disabled ones too."""
    return rules.groupBy("profile").agg(F.sum("rate_percent").alias("target"))
