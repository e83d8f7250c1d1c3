"""Transaction analytics: bucketed sums, categories, extremes, drift, outliers.

Operators take ``by``: columns (as a user) within which they work; the default is the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions import periods
from ledgerspark.functions.amounts import cents, sums, total_of
from ledgerspark.sources.tables import MISSING_CATEGORY

By = Sequence[str]


def by_period(tx: DataFrame, key: Column, by: By = ()) -> DataFrame:
    """period, income, expense, total; rows without a time are dropped."""
    return tx.where("ts is not null").groupBy(*by, key.alias("period")).agg(*sums())


def in_order(found: DataFrame, by: By = ()) -> DataFrame:
    """Periods ascending as text, so that "Group 10" stands before "Group 2"; within `by`."""
    return found.orderBy(*by, "period")


def drift_in_order(found: DataFrame, by: By = ()) -> DataFrame:
    """The largest change first, ties by category; within `by`."""
    return found.orderBy(*by, F.desc("change_pct"), "category")


def interval_profile(tx: DataFrame, minutes: int, by: By = ()) -> DataFrame:
    """Profile over the hours of a day; the date is no part of the key."""
    return by_period(tx, periods.minute_label(F.col("ts"), minutes), by)


def daily_totals(tx: DataFrame, by: By = ()) -> DataFrame:
    return by_period(tx, periods.day_key(F.col("ts")), by)


def day_groups(tx: DataFrame, n: int, by: By = ()) -> DataFrame:
    """Groups of n days that have transactions, counted per `by`; labels sort as text."""
    if n < 1:
        raise ValueError("bucket_days must be at least 1")
    days = daily_totals(tx, by)  # one row a day, so the numbering below is small
    order = Window.partitionBy(*by).orderBy("period")
    numbered = days.withColumn("group_idx", (F.floor((F.row_number().over(order) - 1) / n) + 1).cast("bigint"))
    whole = [total_of(F.col(c)).alias(c) for c in ("income", "expense", "total")]
    return numbered.groupBy(*by, "group_idx").agg(*whole).withColumn("period", F.concat(F.lit("Group "), F.col("group_idx").cast("string")))


def monthly_totals(tx: DataFrame, by: By = ()) -> DataFrame:
    return by_period(tx, periods.month_key(F.col("ts")), by)


def trend(tx: DataFrame, mode: str, by: By = ()) -> DataFrame:
    """mode weekly gives ISO weeks, any other months."""
    return by_period(tx, periods.iso_week_key(F.col("ts")) if mode == "weekly" else periods.month_key(F.col("ts")), by)


def trend_summary(tx: DataFrame, as_of: str, span: str, by: By = ()) -> DataFrame:
    """span 6months by month or 12weeks by ISO week, up to as_of."""
    own = tx.where(F.col("ts").between(periods.trend_start(as_of, span), periods.at(as_of)))
    return trend(own, "weekly" if span == "12weeks" else "monthly", by)


def matching(tx: DataFrame, start: str | None = None, end: str | None = None, kind: str = "all", keyword: str | None = None) -> DataFrame:
    """Category filters: both ends of time or none, sign, and a case-insensitive pattern on the description."""
    out = tx
    if start and end:
        bounds = F.try_to_timestamp(F.lit(start)).cast("timestamp_ntz"), F.try_to_timestamp(F.lit(end)).cast("timestamp_ntz")
        given = bounds[0].isNotNull() & bounds[1].isNotNull()
        out = out.where(~given | F.col("ts").between(*bounds))
    if keyword:
        out = out.where(F.col("description").rlike(f"(?i){keyword}"))
    if kind in ("income", "expense"):
        out = out.where("price > 0" if kind == "income" else "price < 0")
    return out


def category_totals(tx: DataFrame, limit: int | None = None, by: By = ()) -> DataFrame:
    """category, total of magnitudes, count; limit keeps the largest, ties by name (a top-k report)."""
    named = tx.withColumn("category", F.coalesce("category", F.lit(MISSING_CATEGORY))).where("category <> ''")
    out = named.groupBy(*by, "category").agg(total_of(F.abs("price")).alias("total"), F.count("*").alias("count"))
    return out if limit is None else out.orderBy(F.desc("total"), "category").limit(limit)


def category_meta(tx: DataFrame, limit: int) -> DataFrame:
    """Whether the limit cuts categories; empty names count as one."""
    n = tx.agg(F.countDistinct(F.coalesce("category", F.lit(MISSING_CATEGORY))).alias("row_count"))
    cut = F.col("row_count") > limit
    return n.select(cut.alias("truncated"), F.lit(limit).cast("bigint").alias("limit_applied"), "row_count", F.when(cut, F.lit(f"Top {limit} categories returned")).alias("warning"))


def min_max(tx: DataFrame, by: By = ()) -> DataFrame:
    """The greatest and the least transaction: kind, period (instant), total (signed); first by time and id on ties."""
    finite = tx.where(~F.isnan("price") & (F.abs("price") < float("inf")) & F.col("ts").isNotNull())
    row = F.struct("price", "ts", "tx_id")
    least = F.min(row)
    # The greatest price with the least time and id: negated price sorts first.
    most = F.min(F.struct((-F.col("price")).alias("p"), "ts", "tx_id"))
    both = finite.groupBy(*by).agg(least.alias("lo"), most.alias("hi")).where("lo is not null")
    pairs = F.array(F.struct(F.lit("max").alias("kind"), (-F.col("hi.p")).alias("total"), F.col("hi.ts").alias("ts")), F.struct(F.lit("min").alias("kind"), F.col("lo.price").alias("total"), F.col("lo.ts").alias("ts")))
    return both.select(*by, F.explode(pairs).alias("r")).select(*by, "r.kind", periods.iso_instant(F.col("r.ts")).alias("period"), "r.total")


def extreme(tx: DataFrame, kind: str, by: By = ()) -> DataFrame:
    """One end with magnitude and date, only where its sign fits (max above zero, min below)."""
    own = min_max(tx, by).where((F.col("kind") == kind) & ((F.col("total") > 0) if kind == "max" else (F.col("total") < 0)))
    return own.select(*by, F.substring("period", 1, 10).alias("period"), F.abs("total").alias("total"))


def income_expense(tx: DataFrame, by: By = ()) -> DataFrame:
    i, e, _ = sums()
    return tx.groupBy(*by).agg(F.coalesce(i, F.lit(0.0)).alias("income"), F.coalesce(e, F.lit(0.0)).alias("expense"))


def annual_income(tx: DataFrame, year: int, by: By = ()) -> DataFrame:
    """Income from January 1 to the first instant of December 31."""
    own = tx.where(F.col("ts").between(F.lit(f"{year}-01-01").cast("timestamp_ntz"), F.lit(f"{year}-12-31").cast("timestamp_ntz")) & (F.col("price") > 0))
    return own.groupBy(*by).agg(total_of(F.col("price")).alias("income"))


def category_drift(tx: DataFrame, split: str, by: By = ()) -> DataFrame:
    """Change in percent of each category's magnitude from before `split` to after, where there was some before."""
    after = F.col("ts") >= F.lit(split).cast("timestamp_ntz")
    p = cents(F.abs(F.col("price")))
    sides = tx.groupBy(*by, "category").agg(F.sum(F.when(~after, p)).alias("prev"), F.sum(F.when(after, p)).alias("cur"))
    change = (F.col("cur").cast("double") - F.col("prev").cast("double")) / F.col("prev").cast("double") * 100
    return sides.where("prev > 0 and cur is not null").select(*by, "category", F.round(change, 6).alias("change_pct"))


#: Buckets of one pass that looks for a value of a rank.
BUCKETS = 4096


def _at_rank(df: DataFrame, x: Column, rank: int, low: float, high: float) -> float:
    """The value of a rank from 0 on, by passes that each keep one of BUCKETS buckets: counts go to the driver, never values."""
    while low < high:
        width = (high - low) / BUCKETS
        bucket = F.least(F.floor((x - low) / width), F.lit(BUCKETS - 1)) if width > 0 else (x > low).cast("bigint")
        inside = df.where(x.between(low, high)).groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
        for r in sorted(inside.collect(), key=lambda r: r["b"]):  # BUCKETS rows at most
            if rank < r["n"]:
                low, high = r["low"], r["high"]
                break
            rank -= r["n"]
    return low


def global_median(df: DataFrame, x: Column) -> float | None:
    """The exact median of finite values, without gathering them."""
    n, low, high = df.agg(F.count(x), F.min(x), F.max(x)).first()
    if not n:
        return None
    ranks = {(n - 1) // 2, n // 2}
    return sum(_at_rank(df, x, r, low, high) for r in ranks) / len(ranks)


def _global_outliers(clean: DataFrame, threshold: float) -> DataFrame:
    centre = global_median(clean, F.col("price"))
    if centre is None or clean.limit(2).count() < 2:
        return clean.where("false")
    off = F.abs(F.col("price") - centre)
    spread = global_median(clean, off)
    return clean.where(off / spread > threshold) if spread and spread > 0 else clean.where("false")


def mad_outliers(tx: DataFrame, threshold: float, by: By = ()) -> DataFrame:
    """Rows whose distance from the median exceeds threshold times the median distance; none under two values or without spread."""
    clean = tx.where("price is not null and not isnan(price)")
    if not by:
        return _global_outliers(clean.where(F.abs("price") < float("inf")), threshold)
    centre = clean.groupBy(*by).agg(F.median("price").alias("__med"), F.count("*").alias("__n")).where("__n >= 2")
    off = F.abs(F.col("price") - F.col("__med"))
    joined = clean.join(centre, list(by))
    spread = joined.groupBy(*by).agg(F.median(off).alias("__mad")).where("__mad > 0")
    both = joined.join(spread, list(by))
    return both.where(off / F.col("__mad") > threshold).drop("__med", "__n", "__mad")


def recurring_anomalies(tx: DataFrame, every_days: int, tolerance: float, series: By = ("user_id", "description")) -> DataFrame:
    """Missed recurrences (gap over every_days + 2 whole days) and amount anomalies within each series."""
    order = Window.partitionBy(*series).orderBy("ts", "tx_id")
    before = tx.withColumns({"__ts": F.lag("ts").over(order), "__price": F.lag("price").over(order)}).where("__ts is not null")
    gap = F.abs(periods.whole_days(F.col("ts"), F.col("__ts"))) > every_days + 2
    jump = F.abs(F.col("price") - F.col("__price")) / F.greatest(F.abs("__price"), F.lit(1.0)) > tolerance
    found = F.array_compact(F.array(F.when(gap, F.lit("Missed recurrence")), F.when(jump, F.lit("Amount anomaly"))))
    return before.select(*series, "tx_id", periods.iso_instant(F.col("ts")).alias("date"), F.explode(found).alias("message"))


def balance(pages: DataFrame, by: By = ()) -> DataFrame:
    """Sum over rows distinct by id, the last loaded one counting. pages: transactions with load_order."""
    last = pages.groupBy(*by, "tx_id").agg(F.max_by("price", "load_order").alias("price"))
    return last.groupBy(*by).agg(total_of(F.col("price")).alias("balance"))


def page(tx: DataFrame, number: int = 1, size: int = 10) -> DataFrame:
    """One page, newest first."""
    return tx.orderBy(F.desc("ts"), "tx_id").offset((max(number, 1) - 1) * size).limit(size)


def overspent(balances: DataFrame, budget: float) -> DataFrame:
    """Balances with a flag where they lie below the budget as a debt."""
    return balances.withColumn("overspent", F.col("balance") < -budget)


def search(tx: DataFrame, text: str, columns: By = ("name", "description", "category")) -> DataFrame:
    """Rows where any of the columns that tx has contains the text, case aside."""
    hit = F.lit(False)
    for c in (c for c in columns if c in tx.columns):
        hit = hit | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return tx.where(hit)
