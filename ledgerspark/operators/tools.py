"""JSON tools: one row per call, dispatched by name to column expressions and planners.

calls: call_id, tool, args (JSON string), args naming policies and profiles by preset. Result: call_id, tool,
result (JSON string) or error (message for the user). Each tool's rows are handled in one set-based plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions import finance
from ledgerspark.operators import loans, planning, scoring
from ledgerspark.plans import presets

# Messages for users.
INVALID = "Invalid or missing input parameters. Please correct the arguments and retry."
OVERFLOW = "Investment amount exceeds allowed allocation for the selected profile."
DOMAIN = "The request violates domain rules for this financial calculation."
INTERNAL = "Internal calculation error. Please try again later."
UNKNOWN = "Unknown tool"


def user_message(code: Column) -> Column:
    """What the user is told for an error code."""
    plain = code.isin("InvalidInput", "NegativeExpense", "InvalidMonths", "InvalidMultiplier")
    return F.when(code.isNull(), F.lit(None).cast("string")).when(plain, INVALID).when(code == "AllocationOverflow", OVERFLOW).when(code == "CalculationError", INTERNAL).otherwise(DOMAIN)


def _told(df: DataFrame, result: Column, error: Column) -> DataFrame:
    message = user_message(error)
    return df.select("call_id", "tool", F.when(message.isNull(), F.to_json(result)).alias("result"), message.alias("error"))


def _args(calls: DataFrame, ddl: str) -> DataFrame:
    return calls.withColumn("a", F.from_json("args", ddl)).select("call_id", "tool", "a.*")


def _missing(*names: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.col(n).isNull()
    return F.when(out, F.lit("InvalidInput"))


def _lookup(df: DataFrame, name: str, table: dict[str, tuple], fields: tuple[str, ...]) -> DataFrame:
    """Columns of a preset by name; null if there is none such."""
    for i, f in enumerate(fields):
        out = F.lit(None)
        for k, v in table.items():
            out = F.when(F.col(name) == k, F.lit(v[i])).otherwise(out)
        df = df.withColumn(f, out)
    return df


def _emi(calls: DataFrame) -> DataFrame:
    x = _args(calls, "principal double, annual_rate double, tenure_months int")
    p, r, n = F.col("principal"), F.col("annual_rate"), F.col("tenure_months")
    error = F.coalesce(_missing("principal", "annual_rate", "tenure_months"), finance.emi_error(p, r, n))
    return _told(x, F.struct(F.round(F.when(error.isNull(), finance.emi(p, r, F.greatest(n, F.lit(1)))), 4).alias("emi")), error)


def _loan(calls: DataFrame) -> DataFrame:
    ddl = "request struct<monthly_income: double, existing_emi: double, requested_emi: double, credit_score: int, purpose: string, is_joint: boolean>, policy string"
    x = _args(calls, ddl).select("call_id", "tool", "policy", "request.*").withColumns({"existing_emi": F.coalesce("existing_emi", F.lit(0.0)), "is_joint": F.coalesce("is_joint", F.lit(False)), "req_id": F.col("call_id")})
    x = _lookup(x, "policy", presets.EMI_POLICY, ("max_emi_percent", "min_surplus_percent", "income_type", "joint_borrowers"))
    x = _lookup(x, "policy", presets.LOAN_POLICY, ("allow_business", "allow_personal"))
    found = loans.assess_loans(x).withColumnRenamed("req_id", "call_id")
    y = x.select("call_id", "tool", _missing("monthly_income", "requested_emi", "credit_score", "purpose", "max_emi_percent").alias("missing")).join(found, "call_id")
    error = F.coalesce("missing", F.when(~F.col("approved"), F.col("reason")))
    return _told(y, F.struct("approved", "max_allowed_emi", "risk_score", "reason"), error)


def _emergency(calls: DataFrame) -> DataFrame:
    x = _lookup(_args(calls, "monthly_expense double, policy string"), "policy", presets.FINANCE_POLICY, ("months", "multiplier"))
    args = F.col("monthly_expense"), F.col("months"), F.col("multiplier")
    return _told(x, F.struct(F.round(finance.emergency_fund(*args), 4).alias("emergency_fund")), F.coalesce(_missing("monthly_expense", "months"), finance.emergency_error(*args)))


def _savings(calls: DataFrame) -> DataFrame:
    x = _lookup(_args(calls, "months int, policy string"), "policy", presets.FINANCE_POLICY, ("m", "x", "contribution", "growth_frac"))
    error = F.coalesce(_missing("months", "contribution"), F.when((F.col("months") <= 0) | (F.col("contribution") < 0) | (F.col("growth_frac") < 0), F.lit("InvalidInput")))
    value = F.round(finance.savings(F.col("months"), F.col("contribution"), F.col("growth_frac")), 4)
    return _told(x, F.struct(value.alias("projected_savings")), error)


def _planned(amount: str, plan: Callable[[DataFrame], DataFrame], known: dict, key: str, wrap: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """A tool that spreads an amount over a profile's rules: {key: amount, ...}."""

    def run(calls: DataFrame) -> DataFrame:
        x = _args(calls, f"{amount} double, profile string")
        bad = F.coalesce(_missing(amount), F.when(~F.coalesce(F.col("profile").isin(*known), F.lit(False)), F.lit("InvalidInput")))
        x = x.withColumn("bad", bad)
        rows = plan(x.where("bad is null").select(F.col("call_id").alias("id"), F.col(amount).alias("amount"), "profile"))
        value = [c for c in rows.columns if c in ("amount", "tax")][0]
        done = rows.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key), F.col(value))))).alias("m"), F.max("error_code").alias("code"))  # a profile's rules
        y = x.join(done, x["call_id"] == done["id"], "left")
        result = F.struct(F.col("m").alias(wrap)) if wrap else F.col("m")
        return _told(y, result, F.coalesce("bad", "code"))

    return run


def _budget(x: DataFrame) -> DataFrame:
    return planning.plan_budget(x, presets.rules(x.sparkSession, presets.BUDGET))


def _cashflow(x: DataFrame) -> DataFrame:
    return planning.plan_cashflow(x, presets.rules(x.sparkSession, presets.CASHFLOW), presets.FIXED_RATIO)


def _investment(x: DataFrame) -> DataFrame:
    return planning.plan_investment(x, presets.rules(x.sparkSession, presets.INVESTMENT))


def _tax(x: DataFrame) -> DataFrame:
    return loans.tax_by_domain(x, presets.tax_rules(x.sparkSession))


def _similarity(calls: DataFrame) -> DataFrame:
    vector = "struct<user_id: string, metrics: array<double>>"
    x = _args(calls, f"a {vector}, b {vector}, metric string")
    value = F.lit(None).cast("double")
    for name, f in scoring.METRICS.items():
        value = F.when(F.col("metric") == name, f(F.col("a.metrics"), F.col("b.metrics"))).otherwise(value)
    return _told(x, F.struct(F.round(value, 6).alias("score")), F.when(value.isNull(), F.lit("InvalidInput")))


def _stats(calls: DataFrame) -> DataFrame:
    metric = "struct<name: string, category: string, value: double, target: double, measurement: string, weight: double, history: array<double>>"
    x = _args(calls, f"profile struct<metrics: array<{metric}>, alert_policy: string>")
    rows = x.select(F.col("call_id").alias("profile_id"), "profile.alert_policy", F.posexplode("profile.metrics").alias("metric_idx", "m")).select("profile_id", "alert_policy", "metric_idx", "m.*")
    rows = _lookup(rows.withColumn("alert_policy", F.coalesce("alert_policy", F.lit("standard"))), "alert_policy", presets.ALERT_POLICY, ("warning", "critical", "trend"))
    scores = scoring.stat_scores(rows).groupBy("profile_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "score")))).alias("scores"), F.max("error_code").alias("code"))
    told = None
    for policy, bounds in presets.ALERT_POLICY.items():
        own = scoring.stat_alerts(rows.where(F.col("alert_policy") == policy), *bounds)
        told = own if told is None else told.unionByName(own)
    alerts = told.groupBy("profile_id").agg(F.sort_array(F.collect_list(F.struct("metric_idx", "kind", "severity", "message"))).alias("alerts"))
    y = x.select("call_id", "tool").join(scores, F.col("call_id") == scores["profile_id"], "left").join(alerts.withColumnRenamed("profile_id", "p"), F.col("call_id") == F.col("p"), "left")
    return _told(y, F.struct("scores", F.coalesce("alerts", F.expr("array()")).alias("alerts")), F.coalesce("code", F.when(F.col("scores").isNull(), F.lit("InvalidInput"))))


TOOLS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "calculate_emi": _emi,
    "assess_loan": _loan,
    "emergency_fund": _emergency,
    "savings_projection": _savings,
    "calculate_tax": _planned("amount", _tax, presets.TAX, "domain", "taxes"),
    "generate_investment_plan": _planned("investable_amount", _investment, presets.INVESTMENT, "key"),
    "generate_cashflow": _planned("monthly_income", _cashflow, presets.CASHFLOW, "key"),
    "generate_budget": _planned("monthly_income", _budget, presets.BUDGET, "key"),
    "profile_similarity": _similarity,
    "stat_analysis": _stats,
}


def execute(calls: DataFrame) -> DataFrame:
    """Results of all calls; unknown tools are errors."""
    out = calls.where(~F.coalesce(F.col("tool").isin(*TOOLS), F.lit(False))).select("call_id", "tool", F.lit(None).cast("string").alias("result"), F.lit(UNKNOWN).alias("error"))
    for name, run in TOOLS.items():
        out = out.unionByName(run(calls.where(F.col("tool") == name)))
    return out
