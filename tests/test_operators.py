"""Operators on small literal tables."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import analytics, budgets, loans, planning, recurring, scoring, text, tools
from ledgerspark.plans import presets
from ledgerspark.sources import tables, writers

TX = "tx_id bigint, user_id bigint, ts string, price double, category string, description string"


def tx(spark, rows):
    return spark.createDataFrame(rows, TX).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@pytest.fixture(scope="module")
def some(spark):
    return tx(spark, [
        (1, 1, "2024-01-01 10:00:00", 100.0, "salary", "a"), (2, 1, "2024-01-01 10:20:00", -40.0, "food", "b"), (3, 1, "2024-01-05 10:50:00", 0.0, "", "c"),
        (4, 1, "2024-02-10 00:00:00", -60.5, None, "Food court"), (5, 1, None, 7.0, "food", None),
    ])


def test_sums_and_zero_price(some):
    got = {r["period"]: (r["income"], r["expense"], r["total"]) for r in analytics.interval_profile(some, 15).collect()}
    assert got == {"10:00": (100.0, 0.0, 100.0), "10:15": (0.0, 40.0, 40.0), "10:45": (0.0, 0.0, 0.0), "00:00": (0.0, 60.5, 60.5)}


def test_day_groups_sort_as_text(spark):
    rows = [(i, 1, f"2024-01-{i:02d} 00:00:00", 1.0, "c", "d") for i in range(1, 25)]
    got = [r["period"] for r in analytics.day_groups(tx(spark, rows), 2, ("user_id",)).orderBy("period").collect()]
    assert len(got) == 12
    assert got[:4] == ["Group 1", "Group 10", "Group 11", "Group 12"]
    with pytest.raises(ValueError, match="bucket_days"):
        analytics.day_groups(tx(spark, rows), 0)


def test_categories(some):
    got = {r["category"]: (r["total"], r["count"]) for r in analytics.category_totals(some).collect()}
    assert got == {"salary": (100.0, 1), "food": (47.0, 2), "Uncategorized": (60.5, 1)}
    assert [r["category"] for r in analytics.category_totals(some, 1).collect()] == ["salary"]
    assert analytics.matching(some, kind="expense", keyword="FOOD").count() == 1
    assert analytics.matching(some, start="2024-01-01", end="nonsense").count() == 5
    assert analytics.category_meta(some, 2).first()["truncated"]


def test_min_max_ties(spark):
    x = tx(spark, [(1, 1, "2024-01-02", 5.0, "c", "d"), (2, 1, "2024-01-01", 5.0, "c", "d"), (3, 1, "2024-01-01", -5.0, "c", "d"), (4, 1, "2024-01-03", float("inf"), "c", "d")])
    got = {r["kind"]: (r["period"], r["total"]) for r in analytics.min_max(x).collect()}
    assert got == {"max": ("2024-01-01T00:00:00Z", 5.0), "min": ("2024-01-01T00:00:00Z", -5.0)}


def test_mad(spark):
    x = tx(spark, [(i, 1, "2024-01-01", p, "c", "d") for i, p in enumerate((100.0, 105.0, 98.0, 102.0, 5000.0))])
    assert [r["price"] for r in analytics.mad_outliers(x, 2.0).collect()] == [5000.0]
    assert analytics.mad_outliers(x.limit(1), 2.0).count() == 0


def test_recurring_anomalies(spark):
    x = tx(spark, [(1, 1, "2024-01-01", -1000.0, "c", "rent"), (2, 1, "2024-01-31", -1000.0, "c", "rent"), (3, 1, "2024-03-10", -3000.0, "c", "rent")])
    got = sorted((r["date"], r["message"]) for r in analytics.recurring_anomalies(x, 30, 0.3).collect())
    assert got == [("2024-03-10T00:00:00Z", "Amount anomaly"), ("2024-03-10T00:00:00Z", "Missed recurrence")]


def test_breach_is_repeatable(spark):
    days = tx(spark, [(i, 1, f"2024-01-0{i}", -p, "c", "d") for i, p in ((1, 5000.0), (2, 7000.0), (3, 6000.0))])
    stats = budgets.daily_expense_stats(days)
    r = stats.first()
    assert (r["mean"], round(r["std"], 4)) == (6000.0, 816.4966)
    one, two = (budgets.breach(stats, 15000.0, 5, 200).first() for _ in range(2))
    assert one == two
    assert 0 <= one["breach_probability"] <= 1
    assert one["expected_spend"] >= 14400


def test_breach_against_plain_runs(spark):
    """The same draws, added up in Python; more than one block of days; nobody's runs are sorted, merged or windowed."""
    stats = spark.createDataFrame([(1, 100.0, 40.0), (2, 5.0, 90.0), (3, None, None), (4, 300.0, 1.0)], "user_id bigint, mean double, std double")
    horizon, runs, budget = 2 * budgets.DAYS_AT_ONCE + 3, 21, 1500.0
    u = "(pmod(xxhash64(user_id, sim, day, 42, {}), 4503599627370496L) + 1) / 4503599627370497D"
    draws = stats.selectExpr("*", f"explode(sequence(0, {runs - 1})) sim").selectExpr("*", f"explode(sequence(0, {horizon - 1})) day")
    x = {(r[0], r[1], r[2]): r[3] for r in draws.selectExpr("user_id", "sim", "day", f"greatest(mean + std * (sqrt(-2 * ln({u.format(1)})) * cos(2 * pi() * {u.format(2)})), 0D)").collect()}
    joined = stats.select("user_id").join(stats, "user_id", "left")
    got = budgets.breach(joined, budget, horizon, runs)
    rows = {r["user_id"]: r for r in got.collect()}
    for user in (1, 2, 3, 4):
        spent, hits = [], []
        for sim in range(runs):
            total, first = 0.0, None
            for day in range(horizon):
                total += x[user, sim, day] if user != 3 else 0.0
                first = day if first is None and total > budget else first
            spent.append(total)
            hits += [] if first is None else [first]
        want = (len(hits) / runs, sum(spent) / runs, sorted(hits)[len(hits) // 2] if hits else None)
        assert tuple(rows[user][1:]) == pytest.approx(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert "REPARTITION_BY_NUM" in plan.split("Generate")[-1]  # else adaptive execution merges the users into one task


def test_pressure_by_month(spark):
    rows = [("2024-01-10", 500000.0, 10.0, 60), ("2024-01-15", 300000.0, 12.0, 48), ("2024-02-10", 200000.0, 8.0, 24)]
    x = spark.createDataFrame(rows, "ts string, principal double, rate_pct double, months int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert {r["period"]: r["emi"] for r in budgets.emi_monthly_pressure(x).collect()} == {"2024-01": 18523.67, "2024-02": 9045.46}


def test_forecast(spark):
    x = spark.createDataFrame([("2024-01-01", 50000.0, "Monthly"), ("2024-01-05", -10000.0, "Weekly"), ("2024-01-20", 7.0, "Once"), ("2023-01-01", 7.0, "Once")], "ts string, price double, recurring_frequency string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = [(r["date"], r["net"]) for r in recurring.cashflow_forecast(x, "2024-01-10 00:00:00", 30).orderBy("date").collect()]
    assert got == [("2024-01-12", -10000.0), ("2024-01-19", -10000.0), ("2024-01-20", 7.0), ("2024-01-26", -10000.0), ("2024-01-31", 50000.0), ("2024-02-02", -10000.0), ("2024-02-09", -10000.0)]


def _plan(spark, plan, table, profile, amount):
    rows = plan(spark.createDataFrame([(1, float(amount))], "id bigint, amount double"), presets.rules(spark, table, profile)).collect()
    return {r["key"]: r["amount"] for r in rows}, {r["error_code"] for r in rows}


def test_plans(spark):
    got, _ = _plan(spark, planning.plan_budget, presets.BUDGET, "single_young_professional", 100_000)
    assert got == {"Housing": 35000, "Savings": 30000, "Food": 15000, "Transportation": 10000, "Lifestyle": 10000}
    got, _ = _plan(spark, planning.plan_budget, presets.BUDGET, "single_parent", 100_000)
    assert got == {"Housing": 40000, "EmergencyFund": 20000, "Childcare": 20000, "Healthcare": 10000, "Education": 10000}
    got, _ = _plan(spark, planning.plan_investment, presets.INVESTMENT, "young_professional_high_growth", 100_000)
    assert got == {"EmergencyBuffer": 15000, "WealthGrowth": 65000, "Retirement": 20000}
    got, _ = _plan(spark, planning.plan_investment, presets.INVESTMENT, "retiree_income_focused", 120_000)
    assert sorted(got.values()) == [12000, 24000, 84000]
    _, errors = _plan(spark, planning.plan_investment, presets.INVESTMENT, "growing_family_balanced", 50_000)
    assert errors == {"AllocationOverflow"}
    _, errors = _plan(spark, planning.plan_budget, presets.BUDGET, "single_parent", 0)
    assert errors == {"InvalidIncome"}
    fixed = lambda e, r: planning.plan_cashflow(e, r, presets.FIXED_RATIO)
    assert sorted(_plan(spark, fixed, presets.CASHFLOW, "fifty_thirty_twenty", 100_000)[0].values()) == [20000, 30000, 50000]


def test_loan_golden(spark):
    row = (1, 80000.0, 10000.0, 20000.0, 780, "Personal", False, 40.0, 30.0, False, False, True)
    ddl = "req_id bigint, monthly_income double, existing_emi double, requested_emi double, credit_score int, purpose string, is_joint boolean, max_emi_percent double, min_surplus_percent double, joint_borrowers boolean, allow_business boolean, allow_personal boolean"
    r = loans.assess_loans(spark.createDataFrame([row], ddl)).first()
    assert (r["approved"], r["max_allowed_emi"], r["risk_score"]) == (True, 28000.0, 0.1)
    bad = (1, 60000.0, 20000.0, 25000.0, 780, "Home", False, 50.0, 10.0, False, False, True)
    assert loans.assess_loans(spark.createDataFrame([bad], ddl)).first()["reason"] == "EmiTooHigh"


def test_similarity(spark):
    x = spark.createDataFrame([(1, 2, [1.0, 2.0, 3.0], [1.0, 2.0, 6.0]), (1, 3, [0.0, 0.0], [1.0, 1.0]), (1, 4, [], [1.0])], "a_id int, b_id int, a array<double>, b array<double>")
    got = {r["b_id"]: (r["score"], r["error_code"]) for r in scoring.similarity(x, "Euclidean").collect()}
    assert got == {2: (3.0, None), 3: (round(2**0.5, 6), None), 4: (None, "InvalidInput")}
    assert {r["b_id"]: r["error_code"] for r in scoring.similarity(x, "Cosine").collect()}[3] == "InvalidInput"
    assert scoring.similarity(x, "Pearson").where("b_id = 3").first()["score"] is None
    with pytest.raises(ValueError, match="metric"):
        scoring.similarity(x, "Other")


def test_alerts(spark):
    x = spark.createDataFrame([(1, 0, "BMI", "Health", 30.0, 23.0, 1.0, [23.0, 25.0, 30.0])], "profile_id int, metric_idx int, name string, category string, value double, target double, weight double, history array<double>")
    got = [(r["kind"], r["severity"], r["message"]) for r in scoring.stat_alerts(x, *presets.ALERT_POLICY["strict"]).collect()]
    assert got == [("target", "Critical", "BMI is 30.4% away from target 23.0"), ("trend", "Warning", "BMI changed by 20.0% from last measurement")]


def test_guards(spark):
    x = spark.createDataFrame([("calculate my emi",), ("Explain ownership",), (" ",), (None,), ("123 456",), ("a" * 8001,), ("hello world",)], "t string")
    assert [r[0] for r in x.select(text.prompt_error(F.col("t"))).collect()][:4] == ["UseTool", None, "EmptyPrompt", "EmptyPrompt"]
    assert [r[0] for r in x.select(text.embedding_error(F.col("t"))).collect()][2:] == ["EmptyText", "EmptyText", "NumericOnly", "TooLong", None]


def test_validation_and_writers(spark):
    ddl = tables.TRANSACTIONS.split(", emi_meta")[0]
    rows = [(1, 1, None, 5.0, None, None, None, None, None, None), (2, 1, "2024-01-01", float("nan"), None, None, None, None, None, None), (3, 1, "2024-01-01", 5.0, None, None, None, True, None, None), (4, 1, "2024-01-01", 5.0, None, None, None, None, None, None)]
    raw = spark.createDataFrame(rows, ddl.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp"))
    good, bad = tables.validate_transactions(raw)
    assert [(r["tx_id"], r["category"], r["is_recurring"]) for r in good.collect()] == [(4, "General", False)]
    assert {r["tx_id"]: r["reason"] for r in bad.collect()} == {1: "missing_ts", 2: "bad_price", 3: "bad_frequency"}
    now = spark.createDataFrame([(1, 1, 1.0), (2, 1, 2.0)], "tx_id int, user_id int, price double")
    change = spark.createDataFrame([(1, 1, 9.0), (2, 7, 9.0), (3, 1, 3.0)], "tx_id int, user_id int, price double")
    assert sorted(map(tuple, writers.upsert(now, change).collect())) == [(1, 1, 9.0), (2, 1, 2.0), (3, 1, 3.0)]
    assert [r["tx_id"] for r in writers.delete(now, change).collect()] == [2]


def test_generation(spark):
    rows = [(1, 1, "2024-01-01", -5.0, "c", "Monthly", "2024-01-01", (100.0, 12.0, 1, 12)), (2, 1, "2024-02-01", -5.0, "c", "Monthly", "2024-02-01", None), (3, 1, "2024-02-09", -5.0, "c", "Daily", None, None), (4, 1, "2024-01-01", -5.0, "c", None, None, None)]
    ddl = "tx_id int, user_id int, ts string, price double, category string, recurring_frequency string, last_generated_at string, emi_meta struct<principal: double, annual_rate: double, tenure_months: int, original_tenure: int>"
    x = spark.createDataFrame(rows, ddl).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "last_generated_at")})
    assert sorted(r["template_id"] for r in recurring.generate(x, "2024-02-10").collect()) == [1, 3]
    after = {r["tx_id"]: (r["tenure_months"], r["is_recurring"], r["recurring_frequency"]) for r in recurring.next_templates(x, "2024-02-10").collect()}
    assert after == {1: (0, False, None), 3: (None, True, "Daily")}


def test_tools(spark):
    calls = [
        (1, "calculate_emi", '{"principal": 100000, "annual_rate": 12, "tenure_months": 12}'), (2, "calculate_emi", '{"principal": -1, "annual_rate": 12, "tenure_months": 12}'), (3, "calculate_emi", "not json"),
        (4, "generate_budget", '{"monthly_income": 100000, "profile": "single_parent"}'), (5, "generate_investment_plan", '{"investable_amount": 50000, "profile": "growing_family_balanced"}'),
        (6, "calculate_tax", '{"amount": 100000, "profile": "simple_income_tax"}'), (7, "nothing", "{}"), (8, "profile_similarity", '{"a": {"metrics": [1, 0]}, "b": {"metrics": [0, 1]}, "metric": "Cosine"}'),
        (9, "emergency_fund", '{"monthly_expense": 20000, "policy": "default"}'), (10, "generate_cashflow", '{"monthly_income": 100000, "profile": "young_professional"}'),
    ]
    got = {r["call_id"]: (json.loads(r["result"]) if r["result"] else None, r["error"]) for r in tools.execute(spark.createDataFrame(calls, "call_id bigint, tool string, args string")).collect()}
    assert got[1][0]["emi"] == pytest.approx(8884.8789, abs=1e-3)
    assert got[2] == (None, tools.DOMAIN)
    assert got[3] == (None, tools.INVALID)
    assert got[4][0]["Housing"] == 40000
    assert got[5] == (None, tools.OVERFLOW)
    assert got[6][0] == {"taxes": {"Income": 10000.0}}
    assert got[7] == (None, tools.UNKNOWN)
    assert got[8][0] == {"score": 0.0}
    assert got[9][0] == {"emergency_fund": 120000.0}
    assert got[10][0] == {"Essentials": 55000.0, "FinancialStability": 30000.0, "Lifestyle": 15000.0}


def test_affordability_takes_all_instalments(spark):
    """The known budget cases: 10 instalments of 5000, 7000 and 12000 on budgets of 100000 with some spent already."""
    from ledgerspark.functions import finance
    from ledgerspark.operators import budgets

    rows = spark.createDataFrame([(5000, 10000), (7000, 20000), (12000, 30000)], "emi long, spent long")
    u = finance.usage_pct(finance.projected_spend(F.col("emi"), F.lit(10), F.col("spent")), F.lit(100_000).cast("bigint"))
    assert [r[0] for r in rows.orderBy("emi").select(finance.usage_flag(u)).collect()] == [0, 1, 2]
    requests = spark.createDataFrame([(1, 7, "  ", 12000.0, 0.0, 12), (2, 7, "Food", 12000.0, 0.0, 12), (3, 8, None, 1.0, 0.0, 1)], "req_id int, user_id int, category string, principal double, rate_pct double, months int")
    own = spark.createDataFrame([(1, 7, "Overall", 20000.0)], "budget_id int, user_id int, category string, amount double").withColumns({"start_date": F.lit("2024-01-01").cast("timestamp_ntz"), "end_date": F.lit(None).cast("timestamp_ntz")})
    tx = spark.createDataFrame([(1, 7, -3000.0, "Food")], "tx_id int, user_id int, price double, category string").withColumn("ts", F.lit("2024-01-05").cast("timestamp_ntz"))
    got = {r["req_id"]: r for r in budgets.affordability(requests, own, tx, "2024-02-01 00:00:00").collect()}
    assert [(got[i]["emi"], got[i]["remaining"], got[i]["usage_pct"], got[i]["warning"]) for i in (1, 2)] == [(1000.0, 5000.0, 75.0, "SAFE")] * 2
    assert (got[3]["affordable"], got[3]["warning"]) == (True, "NO_BUDGET_DEFINED")


def test_prices_that_are_no_amounts(spark):
    """Infinite, NaN and huge prices count 0, and fail nothing; validation names them."""
    from ledgerspark.operators import analytics

    odd = [float("inf"), float("-inf"), float("nan"), 1e18]
    tx = spark.createDataFrame([(i, 1, p) for i, p in enumerate([5.0, -2.0, *odd])], "tx_id int, user_id int, price double").withColumn("ts", F.lit("2024-01-05").cast("timestamp_ntz"))
    r = analytics.monthly_totals(tx).first()
    assert (r["income"], r["expense"], r["total"]) == (5.0, 2.0, 7.0)


def test_global_median(spark):
    import random
    import statistics

    from ledgerspark.operators import analytics

    rng = random.Random(1)
    for n in (1, 2, 7, 500, 501):
        values = [rng.choice((rng.uniform(-1e6, 1e6), 3.0, 1e-9 * rng.random())) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values], "x double")
        assert analytics.global_median(df, F.col("x")) == statistics.median(values)


def test_cash_flow_within_a_cap(spark):
    """A minimum above its cap is held to the cap."""
    rules = spark.createDataFrame([("p", 0, "Essentials", 45.0, 55.0, 10), ("p", 1, "FinancialStability", 25.0, 35.0, 9), ("p", 2, "Lifestyle", 15.0, 10.0, 6)], "profile string, rule_idx int, key string, min_percent double, max_percent double, priority int")
    got = {r["key"]: r["amount"] for r in planning.plan_cashflow(spark.createDataFrame([(1, 100000.0)], "id int, amount double"), rules).collect()}
    assert got == {"Essentials": 55000.0, "FinancialStability": 35000.0, "Lifestyle": 10000.0}


def test_strict_times(spark):
    from ledgerspark.functions import periods

    rows = spark.createDataFrame([("2024-01-05",), (None,)], "t string")
    assert [str(r[0]) for r in rows.select(periods.strict(F.col("t"))).collect()] == ["2024-01-05 00:00:00", "None"]
    with pytest.raises(Exception, match="not a time"):
        spark.createDataFrame([("5th of May",)], "t string").select(periods.strict(F.col("t"))).collect()
