"""Allocation planners: minimums in rule order, then the rest down the priorities up to each cap.

All bounds are percents of an entity's amount, so each rule's share of it is the same for every entity of a profile: shares
follow once from the rule table, by two running sums over its few rules, and go to the entities by broadcast. Entities
are never shuffled. Rule tables are small by nature (a few rows a profile); their row count is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a rule table that may be broadcast.
MOST_RULES = 10_000
#: Relative slack for sums of doubles.
SLACK = 1e-9


def _with_rules(entities: DataFrame, rules: DataFrame) -> DataFrame:
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"rule tables hold {MOST_RULES} rows at most")
    return entities.join(F.broadcast(rules), "profile") if "profile" in entities.columns else entities.crossJoin(F.broadcast(rules))


def _shares(rules: DataFrame, low: Column) -> DataFrame:
    """rules with low, base, share (all as parts of an amount) and over: what no rule takes."""
    own = Window.partitionBy("profile")
    before = own.orderBy("rule_idx").rowsBetween(Window.unboundedPreceding, -1)
    ranked = own.orderBy(F.desc("priority"), "rule_idx").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    x = rules.withColumns({"low": low, "high": F.col("max_percent") / 100})
    x = x.withColumn("base", F.least("low", F.greatest(1 - F.coalesce(F.sum("low").over(before), zero), zero)))
    x = x.withColumns({"left": 1 - F.sum("base").over(own), "space": F.greatest(F.col("high") - F.col("base"), zero)})
    add = F.greatest(zero, F.least("space", F.col("left") - F.coalesce(F.sum("space").over(ranked), zero)))
    return x.withColumns({"share": F.col("base") + add, "over": F.col("left") - F.sum("space").over(own)})


def _some(c: Column) -> Column:
    return F.max(c.cast("int")).over(Window.partitionBy("profile")) == 1


def plan_budget(entities: DataFrame, rules: DataFrame) -> DataFrame:
    """entities: id, amount (monthly income). One row a category: allocation, or an error code and null."""
    x = _shares(rules, F.col("min_percent") / 100)
    total = F.sum("min_percent").over(Window.partitionBy("profile"))
    x = x.withColumn("rule_error", F.when(total > 100, F.lit("AllocationError")).when(_some(F.col("min_percent") > F.col("max_percent")), F.lit("ProfileInvariantViolated")))
    return _told(entities, x, "InvalidIncome")


def plan_cashflow(entities: DataFrame, rules: DataFrame, fixed: tuple[str, ...] = ()) -> DataFrame:
    """Fixed-ratio profiles give each minimum percent; others are filled by priority, minimums held to their caps."""
    x = _shares(rules, F.least("min_percent", "max_percent") / 100)
    x = x.withColumn("share", F.when(F.col("profile").isin(*fixed), F.col("min_percent") / 100).otherwise(F.col("share"))) if fixed else x
    return _told(entities, x.withColumn("rule_error", F.lit(None).cast("string")), "InvalidIncome")


def plan_investment(entities: DataFrame, rules: DataFrame) -> DataFrame:
    """Strict: everything must be allocated; what caps leave over is an error."""
    x = _shares(rules, F.col("min_percent") / 100)
    error = (
        F.when(_some((F.col("min_percent") < 0) | (F.col("max_percent") < 0)), F.lit("InvalidPercentage"))
        .when(_some(F.col("min_percent") > F.col("max_percent")), F.lit("ProfileInvariantViolated")).when(_some(F.col("base") < F.col("low") - SLACK), F.lit("AllocationOverflow"))
        .when(F.col("over") > SLACK, F.lit("AllocationOverflow"))
    )
    return _told(entities, x.withColumn("rule_error", error), "InvalidAmount")


def assets(plan: DataFrame, split: DataFrame) -> DataFrame:
    """plan by goal as amounts by asset. split: profile, key, asset, asset_percent (a small table); goals without a split drop out."""
    if split.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"split tables hold {MOST_RULES} rows at most")
    rows = plan.where("error_code is null").join(F.broadcast(split), ["profile", "key"])
    return rows.select("id", "profile", "key", "asset", F.round(F.col("amount") * F.col("asset_percent") / 100, 4).alias("amount"))


def lenient(plan: DataFrame) -> DataFrame:
    """Plans without the rows in error."""
    return plan.where("error_code is null")


def _told(entities: DataFrame, shares: DataFrame, invalid: str) -> DataFrame:
    x = _with_rules(entities, shares)
    done = x.withColumn("error_code", F.when(F.col("amount") <= 0, F.lit(invalid)).otherwise(F.col("rule_error")))
    return done.select("id", "profile", "key", F.when(F.col("error_code").isNull(), F.round(F.col("amount") * F.col("share"), 4)).alias("amount"), "error_code")
