"""Preset rule tables of planners and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values: (key, min %, max %, priority) in rule order.
BUDGET = {
    "single_young_professional": [("Housing", 25, 35, 10), ("Food", 10, 15, 8), ("Transportation", 5, 10, 7), ("Savings", 15, 30, 9), ("Lifestyle", 5, 15, 4)],
    "single_parent": [("Housing", 30, 40, 10), ("Childcare", 10, 20, 9), ("Education", 5, 10, 8), ("Healthcare", 5, 10, 9), ("EmergencyFund", 10, 20, 10)],
    "couple_with_dependents": [("Housing", 30, 40, 10), ("Food", 15, 20, 9), ("Healthcare", 8, 12, 9), ("Savings", 10, 25, 8), ("Education", 5, 15, 7)],
}
CASHFLOW = {
    "fifty_thirty_twenty": [("Essentials", 50, 50, 0), ("FinancialStability", 20, 20, 0), ("Lifestyle", 30, 30, 0)],
    "student": [("Essentials", 60, 70, 10), ("FinancialStability", 10, 20, 8), ("Lifestyle", 10, 20, 4)],
    "family": [("Essentials", 65, 75, 10), ("FinancialStability", 15, 25, 9), ("Lifestyle", 5, 15, 3)],
    "young_professional": [("Essentials", 45, 55, 10), ("FinancialStability", 25, 35, 9), ("Lifestyle", 15, 25, 6)],
}
FIXED_RATIO = ("fifty_thirty_twenty",)
INVESTMENT = {
    "young_professional_high_growth": [("EmergencyBuffer", 10, 15, 10), ("WealthGrowth", 40, 70, 9), ("Retirement", 20, 40, 8)],
    "growing_family_balanced": [("ChildEducation", 15, 25, 10), ("HomePurchase", 10, 20, 9), ("Retirement", 25, 40, 8)],
    "retiree_income_focused": [("IncomeGeneration", 50, 70, 10), ("HealthcareContingency", 10, 20, 9), ("LegacyPlanning", 5, 15, 7)],
}
# Assets of goals: (profile, goal, asset, %).
ASSETS = [
    ("young_professional_high_growth", "EmergencyBuffer", "Cash", 100.0), ("young_professional_high_growth", "WealthGrowth", "Equity", 80.0), ("young_professional_high_growth", "WealthGrowth", "Debt", 20.0),
    ("young_professional_high_growth", "Retirement", "Equity", 70.0), ("young_professional_high_growth", "Retirement", "Debt", 30.0),
]
# (domain, rate %, base, priority)
TAX = {
    "simple_income_tax": [("Income", 10.0, "PercentageOfIncome", 10)],
    "investment_tax": [("CapitalGains", 15.0, "PercentageOfAmount", 10)],
    "insurance_tax": [("Insurance", 5.0, "PercentageOfAmount", 5)],
}
# (max EMI %, min surplus %, income type, joint borrowers)
EMI_POLICY = {
    "salaried": (40.0, 30.0, "Salaried", False),
    "self_employed": (30.0, 40.0, "SelfEmployed", False),
    "high_income": (50.0, 25.0, "Salaried", False),
    "low_income": (25.0, 50.0, "Variable", False),
    "joint_borrowers": (45.0, 30.0, "Salaried", True),
}
# (business loans, personal loans)
LOAN_POLICY = {"salaried": (False, True), "self_employed": (True, True), "high_income": (True, True), "low_income": (False, False), "joint_borrowers": (True, True)}
# (months, multiplier, monthly contribution, yearly growth as a fraction)
FINANCE_POLICY = {"default": (6, 1.0, 0.0, 0.0), "millionaire": (1, 1.0, 0.0, 0.0), "conservative": (12, 1.2, 0.0, 0.04)}
# (warning %, critical %, trend %)
ALERT_POLICY = {"standard": (10.0, 20.0, 15.0), "strict": (5.0, 15.0, 10.0), "relaxed": (15.0, 30.0, 20.0)}
# End of fixed values.

RULES = "profile string, rule_idx int, key string, min_percent double, max_percent double, priority int"
TAX_RULES = "profile string, rule_idx int, domain string, rate_percent double, base string, flat_amount double, priority int, enabled boolean"


def rules(spark: SparkSession, presets: dict[str, list[tuple]], *names: str) -> DataFrame:
    """A small rule table of the named profiles, or all."""
    rows = [(p, i, k, float(a), float(b), n) for p, rs in presets.items() if not names or p in names for i, (k, a, b, n) in enumerate(rs)]
    return spark.createDataFrame(rows, RULES)


def tax_rules(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(p, i, d, r, b, None, n, True) for p, rs in TAX.items() if not names or p in names for i, (d, r, b, n) in enumerate(rs)], TAX_RULES)


def asset_split(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASSETS, "profile string, key string, asset string, asset_percent double")


def emi_policies(spark: SparkSession) -> DataFrame:
    """The policies of loans as a small table."""
    rows = [(p, most, surplus, joint, *LOAN_POLICY[p]) for p, (most, surplus, _, joint) in EMI_POLICY.items()]
    return spark.createDataFrame(rows, "policy string, max_emi_percent double, min_surplus_percent double, joint_borrowers boolean, allow_business boolean, allow_personal boolean")


def rural(table: DataFrame) -> DataFrame:
    """Five more percent at most for transportation."""
    from pyspark.sql import functions as F

    return table.withColumn("max_percent", F.when(F.col("key") == "Transportation", F.col("max_percent") + 5).otherwise(F.col("max_percent")))
