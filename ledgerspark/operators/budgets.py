"""Budgets against transactions: lookup, spend, overlap, utilisation, breach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions import finance, periods
from ledgerspark.functions.amounts import cents, expense, total_of, units
from ledgerspark.sources.tables import OVERALL


def _active(start: Column, end: Column, when: Column) -> Column:
    return (start <= when) & (end.isNull() | (end >= when))


def active_budget(budgets: DataFrame, as_of: str) -> DataFrame:
    """Each user's active budget with the latest start."""
    own = budgets.where(_active(F.col("start_date"), F.col("end_date"), periods.at(as_of)))
    order = Window.partitionBy("user_id").orderBy(F.desc("start_date"), "budget_id")
    return own.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def overlapping(budgets: DataFrame, new: DataFrame, as_of: str, how: str = "left_semi") -> DataFrame:
    """new budgets that meet an existing one of the same user and category (left_anti: that meet none)."""
    b, n = budgets.alias("b"), new.alias("n")
    meets = (F.col("b.start_date") <= F.coalesce("n.end_date", periods.at(as_of))) & (F.col("b.end_date").isNull() | (F.col("b.end_date") >= F.col("n.start_date")))
    return n.join(b, (F.col("n.user_id") == F.col("b.user_id")) & (F.col("n.category") == F.col("b.category")) & meets, how)


def spend_in_period(budgets: DataFrame, tx: DataFrame, as_of: str) -> DataFrame:
    """budget_id and what was spent in its scope and time; open ends count to as_of; none is 0."""
    b = budgets.select("budget_id", "user_id", "category", "start_date", F.coalesce("end_date", periods.at(as_of)).alias("until")).alias("b")
    # Summed by instant and scope first, so that both keys join and no pair of a user's rows meets in vain.
    sums = tx.where("price < 0").groupBy("user_id", "category", "ts").agg(F.sum(-cents(F.col("price"))).alias("s"))
    scopes = F.array_distinct(F.array(F.coalesce("category", F.lit(OVERALL)), F.lit(OVERALL)))
    t = sums.select("user_id", F.explode(scopes).alias("scope"), "ts", "s").alias("t")
    inside = F.col("t.ts").between(F.col("b.start_date"), F.col("b.until"))
    joined = b.join(t, (F.col("b.user_id") == F.col("t.user_id")) & (F.col("b.category") == F.col("t.scope")) & inside, "left")
    return joined.groupBy("b.budget_id").agg(F.coalesce(units(F.sum("t.s")), F.lit(0.0)).alias("spent"))


def spend_by_scope(tx: DataFrame) -> DataFrame:
    """All-time expense by user and category, and by user in all, in one pass."""
    sums = tx.where("price < 0").groupBy("user_id", "category").agg(F.sum(-cents(F.col("price"))).alias("s"))
    whole = sums.groupBy("user_id").agg(F.sum("s").alias("s")).select("user_id", F.lit(OVERALL).alias("category"), "s")
    return sums.where(F.col("category") != OVERALL).unionByName(whole).select("user_id", "category", units(F.col("s")).alias("spent"))


def summary(budgets: DataFrame, tx: DataFrame) -> DataFrame:
    """Budget, spent, remaining and the period's label; without spend 0."""
    joined = budgets.join(spend_by_scope(tx), ["user_id", "category"], "left").withColumn("spent", F.coalesce("spent", F.lit(0.0)))
    label = F.concat(periods.day_key(F.col("start_date")), F.lit(" - "), F.coalesce(periods.day_key(F.col("end_date")), F.lit("Ongoing")))
    return joined.select("budget_id", "category", F.col("amount").alias("budget"), "spent", F.round(F.greatest(F.col("amount") - F.col("spent"), F.lit(0.0)), 2).alias("remaining"), label.alias("period"))


def cards(budgets: DataFrame, tx: DataFrame) -> DataFrame:
    """Share spent, at most 100, and whether it is over 80."""
    pct = finance.capped_pct(F.col("spent"), F.col("budget"))
    return summary(budgets, tx).select("budget_id", "spent", F.round(pct, 4).alias("percent"), (pct > 80).alias("danger"))


def utilization(tx: DataFrame, budget: float) -> DataFrame:
    """spent (all magnitudes), remaining and percent of one budget for each user."""
    sums = tx.groupBy("user_id").agg(total_of(F.abs("price")).alias("spent"))
    pct = F.lit(0.0) if budget <= 0 else F.col("spent") / budget * 100
    return sums.select("user_id", "spent", F.round(F.greatest(F.lit(budget) - F.col("spent"), F.lit(0.0)), 2).alias("remaining"), F.round(pct, 6).alias("pct"))


def burn_rate(spent: Column, days: Column, remaining: Column) -> tuple[Column, Column]:
    """Spend a day, and days left (null without spend or days)."""
    rate = F.when(days == 0, 0.0).otherwise(F.try_divide(spent, days))
    return rate, F.when((days != 0) & (rate > 0), F.try_divide(remaining, rate))


def recurring_impact(templates: DataFrame) -> DataFrame:
    """Monthly and yearly weight of recurring amounts: daily 30 times, weekly 4 times a month."""
    factor = F.when(F.col("recurring_frequency") == "Daily", 30).when(F.col("recurring_frequency") == "Weekly", 4).otherwise(1)
    sums = templates.groupBy("user_id").agg(units(F.sum(cents(F.abs("price")) * factor)).alias("monthly"))
    return sums.select("user_id", "monthly", F.round(F.col("monthly") * 12, 2).alias("yearly"))


def daily_expense_stats(tx: DataFrame, by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Mean and spread (population, 1 at least) of expense over days that have some."""
    days = tx.where("price < 0").groupBy(*by, F.to_date("ts").alias("d")).agg(units(F.sum(expense(F.col("price")))).alias("x"))
    return days.groupBy(*by).agg(F.count("*").alias("days"), F.avg("x").alias("mean"), F.greatest(F.stddev_pop("x"), F.lit(1.0)).alias("std"))


#: Days of a simulated run in one generated method: the JVM only interprets methods of more than 8,000 bytes of code.
DAYS_AT_ONCE = 6


def breach(stats: DataFrame, budget: float, horizon: int, simulations: int = 2000, seed: int = 42) -> DataFrame:
    """Monte-Carlo of daily spend over the horizon: probability of a breach, expected spend, median first day of breach.

    stats: mean and std of each `user_id`, null without expenses, which gives 0, 0 and no day. Draws are normal by hashes of
    (user, simulation, day, seed), so that a seed gives the same result on any cluster. Sampling is the feature. A run is
    one row: its days are drawn and added up one after another in generated code, so that no row is sorted, and only
    counts by user and first day are shuffled.
    """
    def uniform(day: int, label: int) -> str:
        return f"((pmod(xxhash64(user_id, sim, {day}, {seed}, {label}), {1 << 52}L) + 1) / {(1 << 52) + 1}D)"

    def drawn(day: int) -> str:
        return f"greatest(mean + std * (sqrt(-2 * ln({uniform(day, 1)})) * cos(2 * pi() * {uniform(day, 2)})), 0D)"

    # Users are few rows, their runs are many: dealt out by a key of their own, since Spark leaves out a repartition by
    # user_id where the rows lie so already, and then merges the few users into one task.
    parts = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = stats.select("user_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "std")])
    dealt = known.repartition(parts, F.xxhash64("user_id", F.lit(seed)))
    runs = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1))).alias("sim")).withColumns({"within": F.lit(0), "spent": F.lit(0.0)})
    for day in range(max(horizon, 1)):
        if day and day % DAYS_AT_ONCE == 0:
            runs = runs.coalesce(parts)  # as many as there are: it merges none and ends the generated method
        # Spend never falls, so the days that end within the budget are as many as the first day of breach.
        within = f"within + int(spent <= {float(budget)}D)" if day else "within"
        runs = runs.selectExpr("user_id", "mean", "std", "sim", f"{within} within", f"spent + {drawn(day)} spent")
    days = runs.groupBy("user_id", F.when(F.col("spent") > budget, F.col("within")).alias("first")).agg(F.count("*").alias("n"), F.sum("spent").alias("s"))
    hits = F.sort_array(F.collect_list(F.when(F.col("first").isNotNull(), F.struct("first", F.col("n").cast("int").alias("n")))))
    each = days.groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.flatten(F.transform(hits, lambda h: F.array_repeat(h["first"], h["n"]))).alias("hits"))
    return each.select("user_id", (F.size("hits") / F.col("n")).alias("breach_probability"), (F.col("s") / F.col("n")).alias("expected_spend"), F.get("hits", F.floor(F.size("hits") / 2).cast("int")).alias("p50_days_to_breach"))


def affordability(requests: DataFrame, budgets: DataFrame, tx: DataFrame, as_of: str) -> DataFrame:
    """Verdict on an instalment for many requests at once.

    requests: req_id, user_id, category, principal, rate_pct, months (rupees). The user's active budget
    of the category (trimmed; none is the overall one) is taken, else the overall one; without any the instalment is
    affordable. All instalments of the loan, and what is spent, must fit the budget.
    """
    requests = requests.withColumn("category", F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit(OVERALL)))
    emi = finance.emi_paise(finance.to_paise(F.col("principal")), F.col("rate_pct"), F.col("months"))
    active = budgets.where(_active(F.col("start_date"), F.col("end_date"), periods.at(as_of)))
    latest = Window.partitionBy("user_id", "category").orderBy(F.desc("start_date"), "budget_id")
    best = active.withColumn("__rn", F.row_number().over(latest)).where("__rn = 1").select("user_id", "category", "budget_id", "amount")
    own = best.select("user_id", "category", F.struct("budget_id", "amount").alias("own"))
    whole = best.where(F.col("category") == OVERALL).select("user_id", F.struct("budget_id", "amount").alias("whole"))
    found = requests.withColumn("emi", emi).join(own, ["user_id", "category"], "left").join(whole, "user_id", "left").withColumn("b", F.coalesce("own", "whole"))
    spent = spend_in_period(active, tx, as_of).select(F.col("budget_id").alias("__spent_on"), "spent")
    found = found.join(spent, F.col("b.budget_id") == F.col("__spent_on"), "left")
    limit, used = finance.to_paise(F.col("b.amount")), finance.to_paise(F.coalesce("spent", F.lit(0.0)))
    projected = finance.projected_spend(F.col("emi"), F.col("months"), used)
    usage = finance.usage_pct(projected, limit)
    none = F.col("b").isNull()
    return found.select(
        "req_id", (F.col("emi") / 100).alias("emi"), (none | (projected <= limit)).alias("affordable"),
        F.when(~none, F.greatest(limit - projected, F.lit(0)) / 100).alias("remaining"), F.when(~none, F.round(usage, 4)).alias("usage_pct"),
        F.when(none, F.lit("NO_BUDGET_DEFINED")).otherwise(finance.usage_warning(usage)).alias("warning"),
    )


def emi_rows(requests: DataFrame, verdicts: DataFrame, as_of: str) -> DataFrame:
    """Recurring expense rows of affordable requests."""
    ok = requests.join(verdicts.where("affordable").select("req_id", "emi"), "req_id")
    meta = F.struct(F.col("principal"), F.col("rate_pct").alias("annual_rate"), F.col("months").alias("tenure_months"), F.col("months").alias("original_tenure"))
    return ok.select("user_id", periods.at(as_of).alias("ts"), (-F.col("emi")).alias("price"), F.coalesce("category", F.lit("EMI")).alias("category"), F.lit("Loan EMI").alias("name"), F.lit(True).alias("is_recurring"), F.lit("Monthly").alias("recurring_frequency"), meta.alias("emi_meta"))


def emi_pressure(loans: DataFrame, tx: DataFrame) -> DataFrame:
    """Instalments of a user's loans against the user's income over all time. loans: user_id, principal, rate_pct, months."""
    emis = loans.groupBy("user_id").agg(F.sum(finance.emi(F.col("principal"), F.coalesce("rate_pct", F.lit(12.0)), F.coalesce("months", F.lit(12))).cast("decimal(28,8)")).cast("double").alias("emi"))
    incomes = tx.where("price > 0").groupBy("user_id").agg(total_of(F.col("price")).alias("income"))
    both = emis.join(incomes, "user_id", "full").select("user_id", F.coalesce("emi", F.lit(0.0)).alias("emi"), F.coalesce("income", F.lit(0.0)).alias("income"))
    score, label = finance.survivability(F.col("income"), F.col("emi"))
    return both.select("user_id", F.round("emi", 2).alias("monthly_emi"), F.round(F.coalesce(F.try_divide("emi", "income"), F.lit(0.0)), 6).alias("emi_ratio"), score.alias("survivability_score"), label.alias("risk_level"))


def emi_monthly_pressure(loans: DataFrame) -> DataFrame:
    """Instalments summed by month of the loan's date."""
    x = finance.emi(F.col("principal"), F.col("rate_pct"), F.col("months")).cast("decimal(28,8)")
    return loans.groupBy(periods.month_key(F.col("ts")).alias("period")).agg(F.round(F.sum(x).cast("double"), 2).alias("emi"))


def active_load(templates: DataFrame, budget: float) -> DataFrame:
    """Monthly outflow of active instalment plans; usage at most 100, high over 80."""
    active = templates.where("recurring_frequency = 'Monthly' and emi_meta is not null and emi_meta.tenure_months > 0")
    out = active.groupBy("user_id").agg(total_of(F.abs("price")).alias("outflow"))
    usage = finance.capped_pct(F.col("outflow"), F.lit(budget))
    return out.select("user_id", "outflow", F.round(usage, 6).alias("usage_pct"), (usage > 80).alias("high"))
