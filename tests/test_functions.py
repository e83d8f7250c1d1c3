"""Goldens of column expressions."""

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import amounts, finance, periods


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_emi_paise(spark):
    def emi(p, r, n):
        return value(spark, finance.emi_paise(F.lit(p), F.lit(float(r)), F.lit(n)))

    assert emi(10_000_000, 12, 12) == 888488
    assert emi(120_000, 0, 12) == 10_000
    assert emi(100_000, 10, 0) == 0
    assert emi(-5, 10, 12) == 0


def test_compound_and_sip(spark):
    assert value(spark, finance.compound(F.lit(100_000), F.lit(10.0), F.lit(2), F.lit(1))) == 121_000
    assert value(spark, finance.compound(F.lit(100_000), F.lit(10.0), F.lit(0), F.lit(1))) == 0
    assert value(spark, finance.sip(F.lit(10_000), F.lit(12.0), F.lit(10), F.lit(12))) == 2_323_391
    assert value(spark, finance.sip(F.lit(10_000), F.lit(0.0), F.lit(1), F.lit(12))) == 120_000


@pytest.mark.parametrize(("m", "budget", "spent", "n", "flag"), [(5000, 100_000, 10_000, 10, 0), (7000, 100_000, 20_000, 10, 1), (12_000, 100_000, 30_000, 10, 2)])
def test_budget_projection(spark, m, budget, spent, n, flag):
    ps = finance.projected_spend(F.lit(m), F.lit(n), F.lit(spent))
    assert value(spark, finance.usage_flag(finance.usage_pct(ps, F.lit(budget)))) == flag


def test_projection_saturates(spark):
    assert value(spark, finance.projected_spend(F.lit(finance.I64), F.lit(3), F.lit(1))) == finance.I64


def test_survivability(spark):
    for income, emi, want in ((100_000, 15_000, (95, "Safe")), (0, 1, (0, "No income detected")), (100, 35, (80, "Manageable")), (100, 50, (55, "High Risk")), (100, 51, (25, "Critical"))):
        s, label = finance.survivability(F.lit(float(income)), F.lit(float(emi)))
        assert (value(spark, s), value(spark, label)) == want


def test_savings_and_reserve(spark):
    assert value(spark, finance.savings(F.lit(12), F.lit(1000.0), F.lit(0.04))) == pytest.approx(12222.4629, abs=1e-3)
    assert value(spark, finance.emergency_fund(F.lit(20000.0), F.lit(6), F.lit(1.0))) == 120_000


def test_period_keys(spark):
    ts = F.lit("2024-12-30 10:47:00").cast("timestamp_ntz")
    assert value(spark, periods.iso_week_key(ts)) == "2025-W01"
    assert value(spark, periods.minute_label(ts, 15)) == "10:45"
    assert value(spark, periods.minute_label(ts, 0)) == "10:47"
    assert value(spark, periods.minute_label(ts, 90)) == "10:00"
    assert value(spark, periods.month_key(ts)) == "2024-12"
    assert value(spark, periods.iso_instant(ts)) == "2024-12-30T10:47:00Z"
    assert value(spark, periods.parsed(F.lit("junk"))) is None
    with pytest.raises(ValueError, match="range"):
        periods.trend_start("2024-01-01", "1year")


def test_normal_amount(spark):
    for raw, want in (("12.5", 12.5), ("x", 0.0), (None, 0.0), ("NaN", 0.0), ("Infinity", 0.0)):
        assert value(spark, amounts.normal_amount(F.lit(raw))) == want
