"""Recurring transactions: generating due ones, and projecting cash flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions import periods
from ledgerspark.functions.amounts import expense, income, total_of, units


def is_due(frequency: Column, last: Column, now: Column) -> Column:
    """Whether the period has changed since the last instance; none yet is due, unknown frequencies never."""
    changed = F.when(frequency == "Daily", F.to_date(last) != F.to_date(now)).when(frequency == "Weekly", periods.plain_week_key(last) != periods.plain_week_key(now)).when(frequency == "Monthly", periods.month_key(last) != periods.month_key(now))
    return F.when(last.isNull(), F.lit(True)).otherwise(F.coalesce(changed, F.lit(False)))


def due_templates(templates: DataFrame, as_of: str) -> DataFrame:
    """Active templates (instalment plans with tenure left, or none) whose period has come."""
    active = templates.where("recurring_frequency is not null and (emi_meta is null or emi_meta.tenure_months > 0)")
    return active.where(is_due(F.col("recurring_frequency"), F.coalesce("last_generated_at", "ts"), periods.at(as_of)))


def generate(templates: DataFrame, as_of: str) -> DataFrame:
    """New instances, dated now and not recurring themselves."""
    return due_templates(templates, as_of).select(F.col("tx_id").alias("template_id"), "user_id", periods.at(as_of).alias("ts"), "price", "category", F.lit(False).alias("is_recurring"))


def next_templates(templates: DataFrame, as_of: str) -> DataFrame:
    """Templates after generation: plans lose a month, and stop recurring at none."""
    left = F.when(F.col("emi_meta").isNotNull(), F.greatest(F.col("emi_meta.tenure_months") - 1, F.lit(0)))
    ended = F.coalesce(left == 0, F.lit(False))
    due = due_templates(templates, as_of)
    return due.select("tx_id", periods.at(as_of).alias("last_generated_at"), left.alias("tenure_months"), (~ended).alias("is_recurring"), F.when(~ended, F.col("recurring_frequency")).alias("recurring_frequency"))


def updated_templates(templates: DataFrame, as_of: str) -> DataFrame:
    """The whole template table after generation: the due ones changed, the others as they were. tx_id, last_generated_at, tenure_months, is_recurring, recurring_frequency."""
    due = next_templates(templates, as_of).select("tx_id", F.struct("last_generated_at", "tenure_months", "is_recurring", "recurring_frequency").alias("new"))
    old = F.struct("last_generated_at", F.col("emi_meta.tenure_months").alias("tenure_months"), F.col("recurring_frequency").isNotNull().alias("is_recurring"), "recurring_frequency")
    return templates.select("tx_id", old.alias("old")).join(due, "tx_id", "left").select("tx_id", F.coalesce("new", "old").alias("t")).select("tx_id", "t.*")


def extended_history(history: DataFrame, templates: DataFrame, as_of: str) -> DataFrame:
    """history (user_id, ts, price, category, is_recurring) with the new instances."""
    new = generate(templates, as_of)
    return history.unionByName(new.select(*history.columns))


def cashflow_forecast(templates: DataFrame, as_of: str, horizon_days: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Occurrences of recurring series from now to the horizon, by date: income, expense, net.

    Steps are 1, 7 and 30 days from the start; the first and last step inside follow by division.
    Series of unknown frequency occur once.
    """
    day = 86_400_000_000
    start, now = F.unix_micros(F.col("ts").cast("timestamp")), F.unix_micros(periods.at(as_of).cast("timestamp"))
    step = F.when(F.col("recurring_frequency") == "Daily", 1).when(F.col("recurring_frequency") == "Weekly", 7).when(F.col("recurring_frequency") == "Monthly", 30)
    width = F.coalesce(step, F.lit(1)).cast("bigint") * day
    first = F.when(step.isNull(), F.lit(0)).otherwise(F.greatest(F.ceil((now - start) / width), F.lit(0))).cast("bigint")
    last = F.when(step.isNull(), F.lit(0)).otherwise(F.floor((now + horizon_days * day - start) / width)).cast("bigint")
    spans = templates.select(*by, "ts", "price", first.alias("k0"), last.alias("k1"), width.alias("w"), start.alias("s")).where("k0 <= k1")
    runs = spans.select(*by, "price", "s", "w", F.explode(F.sequence("k0", "k1")).alias("k"))
    at = F.col("s") + F.col("k") * F.col("w")
    inside = runs.where((at >= now) & (at <= now + horizon_days * day))
    i, e = F.sum(income(F.col("price"))), F.sum(expense(F.col("price")))
    out = inside.groupBy(*by, F.floor(at / F.lit(day)).cast("int").alias("day")).agg(i.alias("i"), e.alias("e"))
    date = F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd")
    return out.select(*by, date.alias("date"), units(F.col("i")).alias("income"), units(F.col("e")).alias("expense"), units(F.col("i") - F.col("e")).alias("net"))


def expected_balance(templates: DataFrame, as_of: str, horizons: tuple[int, ...] = (30, 60, 90)) -> DataFrame:
    """Net of the forecast up to each horizon, from one projection to the longest."""
    days = cashflow_forecast(templates, as_of, max(horizons))
    limit = F.date_add(F.to_date(periods.at(as_of)), F.col("horizon_days"))
    each = days.withColumn("horizon_days", F.explode(F.array(*[F.lit(h) for h in sorted(horizons)]))).where(F.to_date("date") <= limit)
    return each.groupBy("horizon_days").agg(total_of(F.col("net")).alias("expected_balance"))
