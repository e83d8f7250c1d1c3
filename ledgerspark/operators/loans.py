"""Taxes by domain, loan assessment, reserves and savings, with an error code for invalid rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions import finance
from ledgerspark.operators.planning import MOST_RULES, _with_rules


def tax_by_domain(amounts: DataFrame, rules: DataFrame) -> DataFrame:
    """amounts: id, amount. Tax of enabled rules by domain; negative rates or amounts are errors."""
    x = _with_rules(amounts, rules.where("enabled"))
    flat = F.col("base") == "FlatAmount"
    tax = F.when(flat, F.col("flat_amount")).otherwise(F.col("amount") * F.col("rate_percent") / 100)
    bad = F.when(F.col("amount") < 0, F.lit("InvalidAmount")).when(flat & (F.col("flat_amount") < 0), F.lit("InvalidAmount")).when(~flat & (F.col("rate_percent") < 0), F.lit("InvalidPercentage"))
    out = x.groupBy("id", "domain").agg(F.sum(tax).alias("tax"), F.max(bad).alias("error_code"))
    return out.select("id", "domain", F.when(F.col("error_code").isNull(), F.round("tax", 4)).alias("tax"), "error_code")


def policy_error(emi: Column, income: Column, max_pct: Column, surplus_pct: Column) -> Column:
    """First broken rule of an instalment against an income and a policy; null if none."""
    share = F.try_divide(emi, income) * 100
    invalid = (max_pct <= 0) | (max_pct > 100) | (surplus_pct < 0) | (surplus_pct > 100) | (max_pct + surplus_pct > 100)
    return (
        F.when(emi.isNull() | F.isnan(emi) | (emi <= 0), F.lit("InvalidEmi")).when(income <= 0, F.lit("IncomeTooLow")).when(invalid, F.lit("InvalidPolicy"))
        .when(share > max_pct, F.lit("EmiTooHigh")).when(100 - share < surplus_pct, F.lit("InsufficientSurplus"))
    )


def by_policy(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """Each request under each policy of a small table, in one pass over the requests."""
    if policies.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"policy tables hold {MOST_RULES} rows at most")
    return requests.crossJoin(F.broadcast(policies))


def assess_loans(requests: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """requests: req_id, monthly_income, existing_emi, requested_emi, credit_score, purpose, is_joint, and the policy's
    max_emi_percent, min_surplus_percent, joint_borrowers, allow_business, allow_personal.

    Rejections never fail: approved false, nothing allowed, risk 0.7 and the reason's code.
    """
    income = F.col("monthly_income")
    effective = income - F.col("existing_emi") + F.when(F.col("is_joint") & F.col("joint_borrowers"), income).otherwise(F.lit(0.0))
    most = effective * F.col("max_emi_percent") / 100
    score = F.col("credit_score")
    risk = F.when(score.between(750, 900), 0.1).when(score.between(650, 749), 0.3).otherwise(0.6)
    error = (
        F.when(income <= 0, F.lit("InvalidInput")).when((F.col("purpose") == "Business") & ~F.col("allow_business"), F.lit("ProfileInvariantViolated"))
        .when((F.col("purpose") == "Personal") & ~F.col("allow_personal"), F.lit("ProfileInvariantViolated")).when(effective <= 0, F.lit("InvalidIncome"))
        .otherwise(policy_error(F.col("requested_emi"), effective, F.col("max_emi_percent"), F.col("min_surplus_percent")))
    )
    x = requests.withColumns({"error_code": error, "__most": most, "__risk": risk})
    ok = F.col("error_code").isNull()
    return x.select("req_id", *keep, ok.alias("approved"), F.round(F.when(ok, F.col("__most")).otherwise(0.0), 4).alias("max_allowed_emi"), F.when(ok, F.col("__risk")).otherwise(0.7).alias("risk_score"), F.coalesce("error_code", F.lit("Approved")).alias("reason"))


def emergency_funds(people: DataFrame) -> DataFrame:
    """people: id, expense, months, multiplier."""
    args = F.col("expense"), F.col("months"), F.col("multiplier")
    error = finance.emergency_error(*args)
    return people.select("id", F.when(error.isNull(), F.round(finance.emergency_fund(*args), 4)).alias("fund"), error.alias("error_code"))


def savings_projections(people: DataFrame) -> DataFrame:
    """people: id, months, contribution, growth_frac."""
    bad = F.when(F.col("months") <= 0, F.lit("InvalidInput")).when((F.col("contribution") < 0) | (F.col("growth_frac") < 0), F.lit("InvalidInput"))
    return people.select("id", F.when(bad.isNull(), F.round(finance.savings(F.col("months"), F.col("contribution"), F.col("growth_frac")), 4)).alias("projected"), bad.alias("error_code"))
