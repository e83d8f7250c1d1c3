"""Registered queries over the star-schema tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions import finance, periods
from ledgerspark.operators import analytics as A
from ledgerspark.operators import budgets as B
from ledgerspark.operators import loans as L
from ledgerspark.operators import planning as P
from ledgerspark.operators import recurring as R
from ledgerspark.operators import scoring as S
from ledgerspark.operators import text as X
from ledgerspark.operators import tools
from ledgerspark.plans import presets
from ledgerspark.sources import tables as T
from ledgerspark.sources import writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

EVENTS_NOW, ORDERS_NOW, BUDGETS_NOW = "2024-01-20 15:30:00", "2001-08-01 00:00:00", "1999-06-01 00:00:00"
USER = ("user_id",)

TXO = "(select o_orderkey tx_id, o_custkey user_id, o_orderdate ts, case when o_orderstatus = 'O' then o_totalprice else -o_totalprice end price, o_orderpriority category, o_orderpriority description from orders)"
TXE = "(select event_id tx_id, user_id, ts, case when event_type in ('signup', 'view') then value else -value end price, event_type category, props description from events)"
BUD = "(select c_custkey budget_id, c_custkey user_id, case when c_custkey % 2 = 0 then 'Overall' else '1-URGENT' end category, abs(c_acctbal) amount, timestamp '1997-01-01' start_date, case when c_custkey % 3 = 0 then null else timestamp '1999-12-31' end end_date from customer)"
TPL = """(select tx_id, user_id, ts, price, category, ['Daily','Weekly','Monthly','Once'][(tx_id % 4) + 1] recurring_frequency,
  case when tx_id % 5 = 0 then null else ts + interval 40 day end last_generated_at, tx_id % 8 = 2 has_meta, cast(tx_id % 3 as integer) tenure from """ + TXO + ")"
LOANS = "(select l_orderkey order_id, cast(l_linenumber as bigint) line, l_extendedprice principal, round(l_discount * 100, 6) rate_pct, cast(l_quantity as integer) as months, l_shipdate ts from lineitem)"
D = "cast({} as decimal(18,2))"
INC = "cast(sum(case when price > 0 then cast(price as decimal(18,2)) else 0 end) as double)"
EXP = "cast(sum(case when price > 0 then 0 else -cast(price as decimal(18,2)) end) as double)"
TOT = "cast(sum(cast(abs(price) as decimal(18,2))) as double)"
SUMS = f"{INC} income, {EXP} expense, {TOT} total"
#: Instalment as a double, over principal, rate_pct, months.
EMI = "(case when rate_pct > 0 then principal * (rate_pct / 12 / 100) * pow(1 + rate_pct / 12 / 100, months) / (pow(1 + rate_pct / 12 / 100, months) - 1) else principal / months end)"
PAISE = "floor(principal * 100 + 0.5)"


def r2(x: str, places: int = 2) -> str:
    """Half-up rounding of the decimal value, as Spark's."""
    return f"cast(round(cast({x} as decimal(32,10)), {places}) as double)"


def emi_sql(principal: str, rate: str, months: str) -> str:
    r = f"({rate} * 0.01 / 12)"
    g = f"exp({months} * ln(1 + {r}))"
    return f"(case when {principal} <= 0 or {months} <= 0 then 0 when {rate} = 0 then cast(floor({principal} / {months}) as bigint) else cast(round({principal} * {r} * {g} / ({g} - 1)) as bigint) end)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# --- sums by period -------------------------------------------------------------------------------


@query(f"select printf('%02d:%02d', hour(ts), (minute(ts) // 15) * 15) period, {SUMS} from {TXE} group by 1")
def interval_profile_15m(spark: SparkSession, d: str) -> DataFrame:
    return A.interval_profile(T.event_transactions(spark, d), 15)


@query(f"select user_id, strftime(ts, '%Y-%m-%d') period, {SUMS} from {TXE} group by 1, 2")
def daily_totals(spark: SparkSession, d: str) -> DataFrame:
    return A.daily_totals(T.event_transactions(spark, d), USER)


@query(f"""with d as (select user_id, strftime(ts, '%Y-%m-%d') p, {SUMS} from {TXE} group by 1, 2),
n as (select *, (row_number() over (partition by user_id order by p) - 1) // 7 + 1 g from d)
select user_id, cast(g as bigint) group_idx, 'Group ' || g period, cast(sum(cast(income as decimal(18,2))) as double) income, cast(sum(cast(expense as decimal(18,2))) as double) expense, cast(sum(cast(total as decimal(18,2))) as double) total from n group by 1, 2, 3""")
def day_groups_n(spark: SparkSession, d: str) -> DataFrame:
    return A.day_groups(T.event_transactions(spark, d), 7, USER)


@query(f"select user_id, strftime(ts, '%Y-%m') period, {SUMS} from {TXO} group by 1, 2")
def monthly_totals(spark: SparkSession, d: str) -> DataFrame:
    return A.monthly_totals(T.order_transactions(spark, d), USER)


@query(f"select user_id, strftime(ts, '%Y-%m') period, {SUMS} from {TXO} where ts between timestamp '{ORDERS_NOW}' - interval 6 month and timestamp '{ORDERS_NOW}' group by 1, 2")
def trend_monthly(spark: SparkSession, d: str) -> DataFrame:
    return A.trend_summary(T.order_transactions(spark, d), ORDERS_NOW, "6months", USER)


@query(f"select user_id, strftime(ts, '%G-W%V') period, {SUMS} from {TXO} where ts between timestamp '{ORDERS_NOW}' - interval 84 day and timestamp '{ORDERS_NOW}' group by 1, 2")
def trend_weekly(spark: SparkSession, d: str) -> DataFrame:
    return A.trend_summary(T.order_transactions(spark, d), ORDERS_NOW, "12weeks", USER)


@query(f"select strftime(ts, '%G-W%V') period, {SUMS} from {TXO} group by 1")
def weekly_lifetime(spark: SparkSession, d: str) -> DataFrame:
    return A.trend(T.order_transactions(spark, d), "weekly")


@query(f"select user_id, printf('%02d:%02d', hour(ts), minute(ts)) period, {SUMS} from {TXE} where ts between timestamp '2024-01-20' and timestamp '{EVENTS_NOW}' group by 1, 2")
def daily_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.interval_profile(T.event_transactions(spark, d).where(periods.today_so_far(F.col("ts"), EVENTS_NOW)), 1, USER)


@query(f"select user_id, strftime(ts, '%Y-%m-%d') period, {SUMS} from {TXE} where ts between timestamp '2024-01-14' and timestamp '{EVENTS_NOW}' group by 1, 2")
def weekly_summary_rest(spark: SparkSession, d: str) -> DataFrame:
    return A.daily_totals(T.event_transactions(spark, d).where(periods.last_week(F.col("ts"), EVENTS_NOW, True)), USER)


@query(f"select user_id, strftime(ts, '%Y-%m-%d') period, {SUMS} from {TXE} where ts between timestamp '{EVENTS_NOW}' - interval 6 day and timestamp '{EVENTS_NOW}' group by 1, 2")
def weekly_summary_gql(spark: SparkSession, d: str) -> DataFrame:
    return A.daily_totals(T.event_transactions(spark, d).where(periods.last_week(F.col("ts"), EVENTS_NOW, False)), USER)


@query(f"select user_id, strftime(ts, '%Y-%m-%d') period, {SUMS} from {TXE} where ts >= timestamp '2024-01-01' and ts < timestamp '2024-02-01' group by 1, 2")
def monthly_summary_rest(spark: SparkSession, d: str) -> DataFrame:
    return A.daily_totals(T.event_transactions(spark, d).where(periods.this_month(F.col("ts"), EVENTS_NOW, True)), USER)


@query(f"select user_id, strftime(ts, '%Y-%m-%d') period, {SUMS} from {TXE} where ts between timestamp '2024-01-01' and timestamp '{EVENTS_NOW}' group by 1, 2")
def monthly_summary_gql(spark: SparkSession, d: str) -> DataFrame:
    return A.daily_totals(T.event_transactions(spark, d).where(periods.this_month(F.col("ts"), EVENTS_NOW, False)), USER)


# --- categories -----------------------------------------------------------------------------------


@query(f"select coalesce(category, 'Uncategorized') category, {TOT} total, count(*) \"count\" from {TXO} where coalesce(category, 'Uncategorized') <> '' group by 1")
def category_totals(spark: SparkSession, d: str) -> DataFrame:
    return A.category_totals(T.order_transactions(spark, d))


@query(f"select user_id, category, {TOT} total, count(*) \"count\" from {TXO} where category <> '' group by 1, 2")
def category_totals_by_user(spark: SparkSession, d: str) -> DataFrame:
    return A.category_totals(T.order_transactions(spark, d), by=USER)


@query(f"select category, {TOT} total, count(*) \"count\" from {TXO} where category <> '' group by 1 order by 2 desc, 1 limit 3")
def category_top_n(spark: SparkSession, d: str) -> DataFrame:
    return A.category_totals(T.order_transactions(spark, d), 3)


@query(f"select category, {TOT} total, count(*) \"count\" from {TXO} where ts between timestamp '1996-01-01' and timestamp '1997-12-31' and lower(description) like '%urgent%' and price < 0 group by 1 order by 2 desc, 1 limit 10")
def category_filtered_keyword(spark: SparkSession, d: str) -> DataFrame:
    return A.category_totals(A.matching(T.order_transactions(spark, d), "1996-01-01", "1997-12-31", "expense", "URGENT"), 10)


@query(f"select count(distinct category) > 3 truncated, cast(3 as bigint) limit_applied, count(distinct category) row_count, case when count(distinct category) > 3 then 'Top 3 categories returned' end warning from {TXO}")
def category_meta(spark: SparkSession, d: str) -> DataFrame:
    return A.category_meta(T.order_transactions(spark, d), 3)


@query(f"""select user_id, category, round((c - p) / p * 100, 6) change_pct from (select user_id, category, cast(sum(case when ts < timestamp '1998-01-01' then cast(abs(price) as decimal(18,2)) end) as double) p,
cast(sum(case when ts >= timestamp '1998-01-01' then cast(abs(price) as decimal(18,2)) end) as double) c from {TXO} group by 1, 2) where p > 0 and c is not null""")
def category_drift(spark: SparkSession, d: str) -> DataFrame:
    return A.category_drift(T.order_transactions(spark, d), "1998-01-01", USER)


# --- extremes, totals -----------------------------------------------------------------------------

_ENDS = f"select user_id, ts, price, row_number() over (partition by user_id order by price desc, ts, tx_id) hi, row_number() over (partition by user_id order by price, ts, tx_id) lo from {TXO}"


@query(f"with r as ({_ENDS}) select user_id, 'max' kind, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') period, price total from r where hi = 1 union all select user_id, 'min', strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), price from r where lo = 1")
def min_max_transaction(spark: SparkSession, d: str) -> DataFrame:
    return A.min_max(T.order_transactions(spark, d), USER)


@query(f"with r as ({_ENDS}) select user_id, strftime(ts, '%Y-%m-%d') period, abs(price) total from r where hi = 1 and price > 0")
def max_transaction(spark: SparkSession, d: str) -> DataFrame:
    return A.extreme(T.order_transactions(spark, d), "max", USER)


@query(f"with r as ({_ENDS}) select user_id, strftime(ts, '%Y-%m-%d') period, abs(price) total from r where lo = 1 and price < 0")
def min_transaction(spark: SparkSession, d: str) -> DataFrame:
    return A.extreme(T.order_transactions(spark, d), "min", USER)


@query(f"select user_id, {INC} income, {EXP} expense from {TXO} group by 1")
def income_expense_total(spark: SparkSession, d: str) -> DataFrame:
    return A.income_expense(T.order_transactions(spark, d), USER)


@query(f"select user_id, {TOT} income from {TXO} where price > 0 and ts between timestamp '1998-01-01' and timestamp '1998-12-31' group by 1")
def annual_income(spark: SparkSession, d: str) -> DataFrame:
    return A.annual_income(T.order_transactions(spark, d), 1998, USER)


@query(f"with m as (select user_id, median(price) med, count(*) n from {TXO} group by 1), x as (select t.*, abs(price - med) off from {TXO} t join m using (user_id) where n >= 2), s as (select user_id, median(off) mad from x group by 1) select tx_id, user_id, price from x join s using (user_id) where mad > 0 and off / mad > 3.0")
def mad_outliers(spark: SparkSession, d: str) -> DataFrame:
    return A.mad_outliers(T.order_transactions(spark, d), 3.0, USER).select("tx_id", "user_id", "price")


@query(f"with m as (select median(price) med from {TXO}), s as (select mad(price) mad from {TXO}) select tx_id, price from {TXO}, m, s where mad > 0 and abs(price - med) / mad > 1.9")
def mad_outliers_global(spark: SparkSession, d: str) -> DataFrame:
    return A.mad_outliers(T.order_transactions(spark, d), 1.9).select("tx_id", "price")


@query(f"""with l as (select *, lag(ts) over w pts, lag(price) over w pp from {TXO} window w as (partition by user_id, description order by ts, tx_id))
select user_id, description, tx_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') date, 'Missed recurrence' message from l where pts is not null and abs(trunc((epoch_us(ts) - epoch_us(pts)) / 86400000000)) > 32
union all select user_id, description, tx_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), 'Amount anomaly' from l where pts is not null and abs(price - pp) / greatest(abs(pp), 1.0) > 0.3""")
def recurring_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return A.recurring_anomalies(T.order_transactions(spark, d), 30, 0.3)


@query(f"select user_id, cast(sum(cast(price as decimal(18,2))) as double) balance from {TXO} group by 1")
def balance(spark: SparkSession, d: str) -> DataFrame:
    tx = T.order_transactions(spark, d).select("user_id", "tx_id", "price")
    again = tx.where("tx_id % 7 = 0")  # a page that was loaded twice, with an outdated price before
    return A.balance(again.withColumns({"price": F.lit(0.0), "load_order": F.lit(1)}).unionByName(tx.withColumn("load_order", F.lit(2))), USER)


@query(f"select tx_id, user_id, price from {TXO} order by ts desc, tx_id limit 10 offset 10")
def paged_transactions(spark: SparkSession, d: str) -> DataFrame:
    return A.page(T.order_transactions(spark, d), 2).select("tx_id", "user_id", "price")


@query(f"select tx_id, user_id, category, price from {TXO} where lower(description) like '%urg%' or lower(category) like '%urg%'")
def search_transactions(spark: SparkSession, d: str) -> DataFrame:
    return A.search(T.order_transactions(spark, d), "URG").select("tx_id", "user_id", "category", "price")


@query(f"select tx_id, user_id, case when tx_id % 10 = 3 then price * 2 else price end price from {TXO} union all select -tx_id, user_id, price from {TXO} where tx_id % 10 = 4")
def upsert_transactions(spark: SparkSession, d: str) -> DataFrame:
    tx = T.order_transactions(spark, d).select("tx_id", "user_id", "price")
    changed = tx.where("tx_id % 10 = 3").withColumn("price", F.col("price") * 2)
    return writers.upsert(tx, changed.unionByName(tx.where("tx_id % 10 = 4").withColumn("tx_id", -F.col("tx_id"))))


@query(f"select tx_id, user_id, price from {TXO} where tx_id % 10 <> 3")
def delete_transactions(spark: SparkSession, d: str) -> DataFrame:
    tx = T.order_transactions(spark, d).select("tx_id", "user_id", "price")
    return writers.delete(tx, tx.where("tx_id % 10 = 3"))


@query(f"select tx_id, user_id, price from {TXO} where tx_id = 7 and user_id = (select min(user_id) from {TXO} where tx_id = 7)")
def transaction_of_owner(spark: SparkSession, d: str) -> DataFrame:
    tx = T.order_transactions(spark, d)
    owner = tx.where("tx_id = 7").agg(F.min("user_id")).first()[0]
    return T.owned(tx, 7, -1 if owner is None else owner).select("tx_id", "user_id", "price")


@query(f"select tx_id, user_id, case when price > 0 then 'Income' else 'Expense' end kind, '₹' || printf('%.2f', abs(price)) amount, strftime(ts, '%Y-%m-%d') date, category, description from {TXO}")
def receipts(spark: SparkSession, d: str) -> DataFrame:
    return T.receipts(T.order_transactions(spark, d))


@query("select c_custkey id, case when c_custkey % 3 = 0 then 'missing_name' when c_custkey % 5 = 0 then 'missing_message' end reason from customer")
def feedback_checked(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    x = T.table(spark, d, "customer").select(key.alias("id"), F.when(key % 3 != 0, F.col("c_name")).alias("name"), F.lit("a@b").alias("email"), F.when(key % 5 == 0, "  ").otherwise("hello").alias("message"))
    return x.select("id", T.feedback_error().alias("reason"))


@query(f"select strftime(ts, '%G-W%V') period, {SUMS} from {TXO} group by 1 order by 1")
def trend_in_order(spark: SparkSession, d: str) -> DataFrame:
    return A.in_order(A.trend(T.order_transactions(spark, d), "weekly"))


@query(f"""with d as (select strftime(ts, '%Y-%m-%d') p, {SUMS} from {TXE} group by 1), n as (select *, (row_number() over (order by p) - 1) // 2 + 1 g from d)
select cast(g as bigint) group_idx, 'Group ' || g period, cast(sum(cast(income as decimal(18,2))) as double) income, cast(sum(cast(expense as decimal(18,2))) as double) expense, cast(sum(cast(total as decimal(18,2))) as double) total from n group by 1, 2 order by 2""")
def day_groups_in_order(spark: SparkSession, d: str) -> DataFrame:
    return A.in_order(A.day_groups(T.event_transactions(spark, d), 2))


@query(f"""select category, round((c - p) / p * 100, 6) change_pct from (select category, cast(sum(case when ts < timestamp '1998-01-01' then cast(abs(price) as decimal(18,2)) end) as double) p,
cast(sum(case when ts >= timestamp '1998-01-01' then cast(abs(price) as decimal(18,2)) end) as double) c from {TXO} group by 1) where p > 0 and c is not null order by 2 desc, 1""")
def drift_in_order(spark: SparkSession, d: str) -> DataFrame:
    return A.drift_in_order(A.category_drift(T.order_transactions(spark, d), "1998-01-01"))


@query(f"select user_id, balance, balance < -500000.0 overspent from (select user_id, cast(sum(cast(price as decimal(18,2))) as double) balance from {TXO} group by 1)")
def balance_overspent(spark: SparkSession, d: str) -> DataFrame:
    tx = T.order_transactions(spark, d).select("user_id", "tx_id", "price").withColumn("load_order", F.lit(1))
    return A.overspent(A.balance(tx, USER), 500_000.0)


# --- budgets --------------------------------------------------------------------------------------


@query(f"""select b.budget_id, coalesce(cast(sum(cast(-t.price as decimal(18,2))) as double), 0.0) spent from {BUD} b left join {TXO} t on t.user_id = b.user_id and t.price < 0
and t.ts between b.start_date and coalesce(b.end_date, timestamp '{ORDERS_NOW}') and (b.category = 'Overall' or b.category = t.category) group by 1""")
def budget_spend_in_period(spark: SparkSession, d: str) -> DataFrame:
    return B.spend_in_period(T.customer_budgets(spark, d), T.order_transactions(spark, d), ORDERS_NOW)


_SPENT = f"(select b.*, coalesce(cast((select sum(cast(-t.price as decimal(18,2))) from {TXO} t where t.user_id = b.user_id and t.price < 0 and (b.category = 'Overall' or t.category = b.category)) as double), 0.0) spent from {BUD} b)"


@query(f"select budget_id, category, amount budget, spent, round(greatest(amount - spent, 0.0), 2) remaining, strftime(start_date, '%Y-%m-%d') || ' - ' || coalesce(strftime(end_date, '%Y-%m-%d'), 'Ongoing') period from {_SPENT}")
def budget_summary(spark: SparkSession, d: str) -> DataFrame:
    return B.summary(T.customer_budgets(spark, d), T.order_transactions(spark, d))


@query(f"select budget_id, spent, round(case when amount = 0 then 0.0 else least(spent / amount * 100, 100.0) end, 4) \"percent\", case when amount = 0 then false else least(spent / amount * 100, 100.0) > 80 end danger from {_SPENT}")
def budget_cards(spark: SparkSession, d: str) -> DataFrame:
    return B.cards(T.customer_budgets(spark, d), T.order_transactions(spark, d))


def _new_budgets(spark: SparkSession, d: str) -> DataFrame:
    """Later budgets of every fifth customer."""
    return T.customer_budgets(spark, d).where("budget_id % 5 = 0").select((F.col("budget_id") + 10_000_000).alias("budget_id"), "user_id", "category", (F.col("amount") + 1).alias("amount"), F.lit("1999-06-01").cast("timestamp_ntz").alias("start_date"), F.lit(None).cast("timestamp_ntz").alias("end_date"))


_NEW = f"(select budget_id + 10000000 budget_id, user_id, category, amount + 1 amount, timestamp '1999-06-01' start_date, cast(null as timestamp) end_date from {BUD} where budget_id % 5 = 0)"


@query(f"select n.budget_id, n.user_id, n.category from {_NEW} n where exists (select 1 from {BUD} b where b.user_id = n.user_id and b.category = n.category and b.start_date <= coalesce(n.end_date, timestamp '{ORDERS_NOW}') and (b.end_date is null or b.end_date >= n.start_date))")
def budget_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return B.overlapping(T.customer_budgets(spark, d), _new_budgets(spark, d), ORDERS_NOW).select("budget_id", "user_id", "category")


@query(f"select user_id, budget_id, amount from (select *, row_number() over (partition by user_id order by start_date desc, budget_id) rn from (select * from {BUD} union all select * from {_NEW}) where start_date <= timestamp '{BUDGETS_NOW}' and (end_date is null or end_date >= timestamp '{BUDGETS_NOW}')) where rn = 1")
def active_budget(spark: SparkSession, d: str) -> DataFrame:
    return B.active_budget(T.customer_budgets(spark, d).unionByName(_new_budgets(spark, d)), BUDGETS_NOW).select("user_id", "budget_id", "amount")


@query(f"select user_id, spent, round(greatest(1000000.0 - spent, 0.0), 2) remaining, round(spent / 1000000.0 * 100, 6) pct from (select user_id, {TOT} spent from {TXO} group by 1)")
def budget_utilization(spark: SparkSession, d: str) -> DataFrame:
    return B.utilization(T.order_transactions(spark, d), 1_000_000.0)


@query(f"select user_id, round(case when n = 0 then 0.0 else spent / n end, 6) daily_rate, round(case when n <> 0 and spent / n > 0 then greatest(2000000.0 - spent, 0.0) / (spent / n) end, 6) days_left from (select user_id, {TOT} spent, date_diff('day', min(ts), max(ts)) n from {TXO} group by 1)")
def burn_rate(spark: SparkSession, d: str) -> DataFrame:
    x = T.order_transactions(spark, d).groupBy("user_id").agg(A.total_of(F.abs("price")).alias("spent"), F.datediff(F.max("ts"), F.min("ts")).alias("n"))
    rate, left = B.burn_rate(F.col("spent"), F.col("n"), F.greatest(F.lit(2_000_000.0) - F.col("spent"), F.lit(0.0)))
    return x.select("user_id", F.round(rate, 6).alias("daily_rate"), F.round(left, 6).alias("days_left"))


@query(f"select user_id, m monthly, round(m * 12, 2) yearly from (select user_id, cast(sum(cast(abs(price) as decimal(18,2)) * case recurring_frequency when 'Daily' then 30 when 'Weekly' then 4 else 1 end) as double) m from {TPL} group by 1)")
def recurring_impact(spark: SparkSession, d: str) -> DataFrame:
    return B.recurring_impact(T.order_templates(spark, d))


@query(f"select user_id, count(*) as days, round(avg(x), 6) mean, round(greatest(stddev_pop(x), 1.0), 6) std from (select user_id, cast(ts as date) d, {EXP} x from {TXE} where price < 0 group by 1, 2) group by 1")
def daily_expense_stats(spark: SparkSession, d: str) -> DataFrame:
    x = B.daily_expense_stats(T.event_transactions(spark, d))
    return x.select("user_id", "days", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query()
def budget_breach_mc(spark: SparkSession, d: str) -> DataFrame:
    """Simulated for each user, also those without expenses; a fixed seed, no SQL."""
    tx = T.event_transactions(spark, d)
    stats = tx.select("user_id").distinct().join(B.daily_expense_stats(tx), "user_id", "left")
    return B.breach(stats, 5000.0, 30)


_OLD_NEW = f"(select *, row_number() over (partition by new_id order by budget_id) rn from (select n.budget_id new_id, n.amount na, n.start_date ns, n.end_date ne, b.budget_id from {_NEW} n join {BUD} b on b.user_id = n.user_id and b.category = n.category and (n.end_date is null or b.start_date <= n.end_date) and (b.end_date is null or b.end_date >= n.start_date)))"


@query(f"""with m as (select * from {_OLD_NEW} where rn = 1) select b.budget_id, b.user_id, b.category, coalesce(m.na, b.amount) amount, strftime(coalesce(m.ns, b.start_date), '%Y-%m-%d') start_day, case when m.new_id is null then strftime(b.end_date, '%Y-%m-%d') end end_day from {BUD} b left join m using (budget_id)
union all select budget_id, user_id, category, amount, strftime(start_date, '%Y-%m-%d'), null from {_NEW} where budget_id not in (select new_id from m)""")
def budget_upsert(spark: SparkSession, d: str) -> DataFrame:
    x = writers.upsert_budgets(T.customer_budgets(spark, d), _new_budgets(spark, d))
    return x.select("budget_id", "user_id", "category", "amount", periods.day_key(F.col("start_date")).alias("start_day"), periods.day_key(F.col("end_date")).alias("end_day"))


@query(f"select budget_id, amount, created_at from (select budget_id, amount, start_date + to_days(cast(budget_id % 50 as integer)) created_at from {BUD} where user_id % 2 = 0) order by created_at desc, budget_id")
def budgets_newest_first(spark: SparkSession, d: str) -> DataFrame:
    own = T.customer_budgets(spark, d).where("user_id % 2 = 0").withColumn("created_at", F.expr("start_date + make_dt_interval(cast(budget_id % 50 as int))"))
    return T.newest_first(own).select("budget_id", "amount", "created_at")


@query(f"select user_id, round(spent / greatest(floor((epoch_us(b) - epoch_us(a)) / 86400000000), 1), 6) daily_rate from (select user_id, {TOT} spent, min(ts) a, max(ts) b from {TXE} group by 1)")
def period_daily_rate(spark: SparkSession, d: str) -> DataFrame:
    x = T.event_transactions(spark, d).groupBy("user_id").agg(A.total_of(F.abs("price")).alias("spent"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return x.select("user_id", F.round(F.col("spent") / periods.period_days(F.col("b"), F.col("a")), 6).alias("daily_rate"))


# --- loans and interest ---------------------------------------------------------------------------


@query(f"select order_id, line, {emi_sql(PAISE, 'rate_pct', 'months')} emi from {LOANS}")
def emi_batch(spark: SparkSession, d: str) -> DataFrame:
    return T.lineitem_loans(spark, d).select("order_id", "line", finance.emi_paise(finance.to_paise(F.col("principal")), F.col("rate_pct"), F.col("months")).alias("emi"))


@query(f"select order_id, line, {r2(EMI)} emi from {LOANS}")
def emi_quote(spark: SparkSession, d: str) -> DataFrame:
    return T.lineitem_loans(spark, d).select("order_id", "line", finance.quote(F.col("principal"), F.col("rate_pct"), F.col("months")).alias("emi"))


@query(f"""select order_id, line, case when err is null then {r2('e')} end emi, err error_code, err is null or err = 'InvalidEmi' valid, round(case when rate_pct = 0 or months = 0 then 0.0 else e end, 4) form_emi from
(select *, case when principal <= 0 then 'InvalidPrincipal' when rate_pct <= 0 then 'InvalidRate' when months <= 0 then 'InvalidTenure' end err, {EMI} e from {LOANS})""")
def emi_strict(spark: SparkSession, d: str) -> DataFrame:
    p, r, m = F.col("principal"), F.col("rate_pct"), F.col("months")
    error = finance.emi_error(p, r, m)
    return T.lineitem_loans(spark, d).select("order_id", "line", F.when(error.isNull(), finance.quote(p, r, m)).alias("emi"), error.alias("error_code"), finance.valid_emi_input(p, r, m).alias("valid"), F.round(finance.emi_or_zero(p, r, m), 4).alias("form_emi"))


@query(f"select order_id, line, emi, {r2('emi * months')} payable, {r2('emi * months - principal')} interest from (select *, {r2(EMI)} emi from {LOANS})")
def loan_totals(spark: SparkSession, d: str) -> DataFrame:
    x = T.lineitem_loans(spark, d).withColumn("emi", finance.quote(F.col("principal"), F.col("rate_pct"), F.col("months")))
    return x.select("order_id", "line", "emi", finance.payable(F.col("emi"), F.col("months")).alias("payable"), finance.interest(F.col("emi"), F.col("months"), F.col("principal")).alias("interest"))


@query(f"select order_id, line, case when p <= 0 or rate_pct < 0 or months <= 0 then 0 else cast(round(p * exp(4 * months * ln(1 + rate_pct * 0.01 / 4))) as bigint) end amount from (select *, {PAISE} p from {LOANS})")
def compound_interest(spark: SparkSession, d: str) -> DataFrame:
    return T.lineitem_loans(spark, d).select("order_id", "line", finance.compound(finance.to_paise(F.col("principal")), F.col("rate_pct"), F.col("months"), F.lit(4)).alias("amount"))


@query(f"select order_id, line, case when p <= 0 or rate_pct < 0 or y <= 0 then 0 when rate_pct = 0 then cast(p * y * 12 as bigint) else cast(round(p * (exp(y * 12 * ln(1 + r)) - 1) / r * (1 + r)) as bigint) end value from (select *, {PAISE} p, months % 10 y, rate_pct * 0.01 / 12 r from {LOANS})")
def sip_future_value(spark: SparkSession, d: str) -> DataFrame:
    return T.lineitem_loans(spark, d).select("order_id", "line", finance.sip(finance.to_paise(F.col("principal")), F.col("rate_pct"), F.col("months") % 10, F.lit(12)).alias("value"))


@query("""select c_custkey id, ps projected, round(u, 6) usage, case when u >= 100 then 2 when u >= 80 then 1 else 0 end flag from (select *, case when b > 0 then ps / cast(b as double) * 100 else 100.0 end u from
(select c_custkey, cast(floor(c_acctbal * 100 + 0.5) as bigint) b, cast(least(cast(50000 as hugeint) * (c_custkey % 12) + 1000, 9223372036854775807) as bigint) ps from customer))""")
def budget_projection(spark: SparkSession, d: str) -> DataFrame:
    x = T.table(spark, d, "customer").select("c_custkey", finance.to_paise(F.col("c_acctbal")).alias("b"), finance.projected_spend(F.lit(50_000), F.col("c_custkey") % 12, F.lit(1000)).alias("ps"))
    u = finance.usage_pct(F.col("ps"), F.col("b"))
    return x.select(F.col("c_custkey").alias("id"), F.col("ps").alias("projected"), F.round(u, 6).alias("usage"), finance.usage_flag(u).alias("flag"))


@query(f"select strftime(ts, '%Y-%m') period, round(cast(sum(cast({EMI} as decimal(28,8))) as double), 2) emi from {LOANS} group by 1")
def emi_monthly_pressure(spark: SparkSession, d: str) -> DataFrame:
    return B.emi_monthly_pressure(T.lineitem_loans(spark, d))


_BAND = "case when income <= 0 then {0} when r <= 0.2 then {1} when r <= 0.35 then {2} when r <= 0.5 then {3} else {4} end"
_SCORE, _LABEL = _BAND.format(0, 95, 80, 55, 25), _BAND.format("'No income detected'", "'Safe'", "'Manageable'", "'High Risk'", "'Critical'")


@query(f"select c_custkey id, {_SCORE} score, {_LABEL} label from (select c_custkey, c_acctbal income, (c_custkey % 1000) * 2.0 / nullif(c_acctbal, 0) r from customer)")
def emi_survivability(spark: SparkSession, d: str) -> DataFrame:
    score, label = finance.survivability(F.col("c_acctbal"), (F.col("c_custkey") % 1000) * 2.0)
    return T.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), score.alias("score"), label.alias("label"))


@query(f"""select user_id, round(emi, 2) monthly_emi, round(coalesce(case when income = 0 then null else emi / income end, 0.0), 6) emi_ratio, {_SCORE} survivability_score, {_LABEL} risk_level from
(select *, case when income = 0 then null else emi / income end r from (select user_id, coalesce(emi, 0.0) emi, coalesce(income, 0.0) income from
(select o_custkey user_id, cast(sum(cast({EMI} as decimal(28,8))) as double) emi from {LOANS} l join orders on o_orderkey = order_id group by 1) full join (select user_id, {TOT} income from {TXO} where price > 0 group by 1) using (user_id)))""")
def emi_pressure(spark: SparkSession, d: str) -> DataFrame:
    owners = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"))
    return B.emi_pressure(T.lineitem_loans(spark, d).join(owners, "order_id"), T.order_transactions(spark, d))


_REQ = "(select c_custkey req_id, c_custkey user_id, case when c_custkey % 4 = 1 then '1-URGENT' else '3-MEDIUM' end category, abs(c_acctbal) * 20 principal, 12.0 rate_pct, 24 as months from customer)"
_REQ_EMI = emi_sql("floor(principal * 100 + 0.5)", "rate_pct", "months")


@query(f"""with b as (select * from {BUD} where start_date <= timestamp '{BUDGETS_NOW}' and (end_date is null or end_date >= timestamp '{BUDGETS_NOW}')),
s as (select b.budget_id, coalesce(cast(sum(cast(-t.price as decimal(18,2))) as double), 0.0) spent from b left join {TXO} t on t.user_id = b.user_id and t.price < 0 and t.ts between b.start_date and coalesce(b.end_date, timestamp '{BUDGETS_NOW}') and (b.category = 'Overall' or b.category = t.category) group by 1),
q as (select r.req_id, r.months, {_REQ_EMI} emi, coalesce(b1.budget_id, b2.budget_id) budget_id, cast(floor(coalesce(b1.amount, b2.amount) * 100 + 0.5) as bigint) lim from {_REQ} r left join b b1 on b1.user_id = r.user_id and b1.category = r.category left join b b2 on b2.user_id = r.user_id and b2.category = 'Overall'),
p as (select q.*, emi * months + cast(floor(coalesce(spent, 0.0) * 100 + 0.5) as bigint) ps from q left join s using (budget_id)),
u as (select *, case when lim > 0 then ps / cast(lim as double) * 100 else 100.0 end u from p)
select req_id, emi / 100 emi, budget_id is null or ps <= lim affordable, case when budget_id is not null then greatest(lim - ps, 0) / 100 end remaining, case when budget_id is not null then round(u, 4) end usage_pct,
case when budget_id is null then 'NO_BUDGET_DEFINED' when u >= 100 then 'BUDGET_EXCEEDED' when u >= 80 then 'BUDGET_NEAR_LIMIT' else 'SAFE' end warning from u""")
def emi_affordability(spark: SparkSession, d: str) -> DataFrame:
    return B.affordability(_requests(spark, d), T.customer_budgets(spark, d), T.order_transactions(spark, d), BUDGETS_NOW)


def _requests(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    return T.table(spark, d, "customer").select(key.alias("req_id"), key.alias("user_id"), F.when(key % 4 == 1, " 1-URGENT ").otherwise("3-MEDIUM").alias("category"), (F.abs("c_acctbal") * 20).alias("principal"), F.lit(12.0).alias("rate_pct"), F.lit(24).alias("months"))


@query(f"select req_id user_id, -({_REQ_EMI}) / 100 price, trim(category) category, cast(rate_pct as double) annual_rate, cast(months as bigint) tenure_months from {_REQ} where req_id in (select req_id from ({SQL['emi_affordability']}) where affordable)")
def emi_expense_rows(spark: SparkSession, d: str) -> DataFrame:
    requests = _requests(spark, d)
    verdicts = B.affordability(requests, T.customer_budgets(spark, d), T.order_transactions(spark, d), BUDGETS_NOW)
    rows = B.emi_rows(requests.withColumn("category", F.trim("category")), verdicts, BUDGETS_NOW)
    return rows.select("user_id", "price", "category", "emi_meta.annual_rate", F.col("emi_meta.tenure_months").cast("bigint").alias("tenure_months"))


@query(f"select tx_id, round(case when tenure = 12 then 0.0 else (12 - tenure) * 100.0 / 12 end, 6) progress_pct from {TPL} where has_meta")
def emi_progress(spark: SparkSession, d: str) -> DataFrame:
    x = T.order_templates(spark, d).where("emi_meta is not null")
    return x.select("tx_id", F.round(finance.progress_pct(F.col("emi_meta.tenure_months"), F.col("emi_meta.original_tenure")), 6).alias("progress_pct"))


@query(f"select user_id, outflow, round(least(outflow / 200000.0 * 100, 100.0), 6) usage_pct, least(outflow / 200000.0 * 100, 100.0) > 80 high from (select user_id, {TOT} outflow from {TPL} where has_meta and tenure > 0 and recurring_frequency = 'Monthly' group by 1)")
def active_emi_load(spark: SparkSession, d: str) -> DataFrame:
    return B.active_load(T.order_templates(spark, d), 200_000.0)


# --- recurring ------------------------------------------------------------------------------------

_WEEK = "(year({0}) || '-W' || cast(ceil((dayofyear({0}) - 1 + dayofweek(date_trunc('year', {0})) + 1) / 7.0) as integer))"
_N = f"timestamp '{ORDERS_NOW}'"
_DUE = f"""(select *, coalesce(last_generated_at, ts) last from {TPL} where (not has_meta or tenure > 0)) where case recurring_frequency when 'Daily' then cast(last as date) <> cast({_N} as date)
 when 'Weekly' then {_WEEK.format('last')} <> {_WEEK.format(_N)} when 'Monthly' then strftime(last, '%Y-%m') <> strftime({_N}, '%Y-%m') else false end"""


@query(f"select tx_id template_id, user_id, strftime({_N}, '%Y-%m-%dT%H:%M:%SZ') as \"at\", price, category, false is_recurring from {_DUE}")
def recurring_generate(spark: SparkSession, d: str) -> DataFrame:
    x = R.generate(T.order_templates(spark, d), ORDERS_NOW)
    return x.select("template_id", "user_id", periods.iso_instant(F.col("ts")).alias("at"), "price", "category", "is_recurring")


@query(f"select tx_id, case when has_meta then greatest(tenure - 1, 0) end tenure_months, not (has_meta and tenure <= 1) is_recurring, case when not (has_meta and tenure <= 1) then recurring_frequency end recurring_frequency from {_DUE}")
def recurring_templates_next(spark: SparkSession, d: str) -> DataFrame:
    return R.next_templates(T.order_templates(spark, d), ORDERS_NOW).drop("last_generated_at")


@query(f"""with due as (select tx_id from {_DUE}) select tx_id, case when tx_id in (select tx_id from due) then strftime({_N}, '%Y-%m-%d') else strftime(last_generated_at, '%Y-%m-%d') end last_day,
case when has_meta then case when tx_id in (select tx_id from due) then greatest(tenure - 1, 0) else tenure end end tenure_months,
not (tx_id in (select tx_id from due) and has_meta and tenure <= 1) is_recurring, case when not (tx_id in (select tx_id from due) and has_meta and tenure <= 1) then recurring_frequency end recurring_frequency from {TPL}""")
def recurring_templates_all(spark: SparkSession, d: str) -> DataFrame:
    x = R.updated_templates(T.order_templates(spark, d), ORDERS_NOW)
    return x.select("tx_id", periods.day_key(F.col("last_generated_at")).alias("last_day"), "tenure_months", "is_recurring", "recurring_frequency")


@query(f"select user_id, strftime(ts, '%Y-%m-%d') as \"day\", price, category, false is_recurring from {TXO} union all select user_id, strftime({_N}, '%Y-%m-%d'), price, category, false from {_DUE}")
def recurring_history(spark: SparkSession, d: str) -> DataFrame:
    history = T.order_transactions(spark, d).select("user_id", "ts", "price", "category", F.lit(False).alias("is_recurring"))
    x = R.extended_history(history, T.order_templates(spark, d), ORDERS_NOW)
    return x.select("user_id", periods.day_key(F.col("ts")).alias("day"), "price", "category", "is_recurring")


_FLOW = f"""(with t as (select price, epoch_us(ts) s, case recurring_frequency when 'Daily' then 1 when 'Weekly' then 7 when 'Monthly' then 30 end step from {TPL}),
n as (select epoch_us({_N}) now), k as (select price, s, coalesce(step, 1) * 86400000000 w, case when step is null then 0 else cast(greatest(ceil((now - s) / (step * 86400000000.0)), 0) as bigint) end k0,
 case when step is null then 0 else cast(floor((now + 90 * 86400000000 - s) / (step * 86400000000.0)) as bigint) end k1 from t, n)
select price, s + unnest(generate_series(k0, k1)) * w at_us from k where k0 <= k1)"""


@query(f"select strftime(make_timestamp(at_us), '%Y-%m-%d') date, {INC} income, {EXP} expense, cast(sum(cast(price as decimal(18,2))) as double) net from {_FLOW} where at_us between epoch_us({_N}) and epoch_us({_N}) + 90 * 86400000000 group by 1")
def cashflow_forecast(spark: SparkSession, d: str) -> DataFrame:
    return R.cashflow_forecast(T.order_templates(spark, d), ORDERS_NOW, 90)


@query(f"select h horizon_days, cast(sum(cast(price as decimal(18,2))) as double) expected_balance from {_FLOW}, (select unnest([30, 60, 90]) h) where at_us >= epoch_us({_N}) and at_us <= epoch_us({_N}) + 90 * 86400000000 and cast(make_timestamp(at_us) as date) <= cast({_N} as date) + h group by 1")
def expected_balance(spark: SparkSession, d: str) -> DataFrame:
    return R.expected_balance(T.order_templates(spark, d), ORDERS_NOW)


# --- planners -------------------------------------------------------------------------------------


def _values(name: str, rules: dict, *only: str) -> str:
    rows = [f"('{p}', {i}, '{k}', {a}.0, {b}.0, {n})" for p, rs in rules.items() if not only or p in only for i, (k, a, b, n) in enumerate(rs)]
    return f"(values {', '.join(rows)}) {name}(profile, rule_idx, key, lo, hi, prio)"


def _waterfall_sql(rules: dict, amount: str, low: str, error: str, fixed: str = "false") -> str:
    """Allocation by running sums, over customers."""
    return f"""with e as (select c_custkey id, {amount} amount from customer), j as (select id, amount, r.*, greatest(amount, 0.0) am from e, {_values('r', rules)}),
a as (select *, {low} mn, am * hi / 100 mx from j),
b as (select *, least(mn, greatest(am - coalesce(sum(mn) over (partition by id, profile order by rule_idx rows between unbounded preceding and 1 preceding), 0), 0)) base from a),
c as (select *, am - sum(base) over (partition by id, profile) lft, greatest(mx - base, 0) space from b),
d as (select *, base + greatest(0, least(space, lft - coalesce(sum(space) over (partition by id, profile order by prio desc, rule_idx rows between unbounded preceding and 1 preceding), 0))) alloc, lft - sum(space) over (partition by id, profile) ov,
 sum(lo) over (partition by id, profile) los from c), f as (select *, {error} error_code from d)
select id, profile, key, case when error_code is null then round(case when {fixed} then am * lo / 100 else alloc end, 4) end amount, error_code from f"""


def _incomes(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"))


@query(_waterfall_sql(presets.BUDGET, "c_acctbal", "am * lo / 100", "case when amount <= 0 then 'InvalidIncome' when los > 100 then 'AllocationError' end"))
def plan_budget(spark: SparkSession, d: str) -> DataFrame:
    return P.plan_budget(_incomes(spark, d), presets.rules(spark, presets.BUDGET))


@query(_waterfall_sql(presets.CASHFLOW, "c_acctbal", "least(am * lo / 100, am * hi / 100)", "case when amount <= 0 then 'InvalidIncome' end", "profile = 'fifty_thirty_twenty'"))
def plan_cashflow(spark: SparkSession, d: str) -> DataFrame:
    return P.plan_cashflow(_incomes(spark, d), presets.rules(spark, presets.CASHFLOW), presets.FIXED_RATIO)


@query("select c_custkey id, 'fifty_thirty_twenty' profile, key, case when c_acctbal > 0 then round(c_acctbal * p / 100, 4) end amount, case when c_acctbal <= 0 then 'InvalidIncome' end error_code from customer, (values ('Essentials', 50.0), ('FinancialStability', 20.0), ('Lifestyle', 30.0)) v(key, p)")
def plan_cashflow_fixed(spark: SparkSession, d: str) -> DataFrame:
    return P.plan_cashflow(_incomes(spark, d), presets.rules(spark, presets.CASHFLOW, *presets.FIXED_RATIO), presets.FIXED_RATIO)


@query(_waterfall_sql(presets.INVESTMENT, "c_acctbal", "am * lo / 100", "case when amount <= 0 then 'InvalidAmount' when max(case when base < mn - abs(amount) * 1e-9 then 1 else 0 end) over (partition by id, profile) = 1 then 'AllocationOverflow' when ov > abs(amount) * 1e-9 then 'AllocationOverflow' end"))
def plan_investment(spark: SparkSession, d: str) -> DataFrame:
    return P.plan_investment(_incomes(spark, d), presets.rules(spark, presets.INVESTMENT))


_SPLIT = "(values " + ", ".join(f"('{p}', '{k}', '{a}', {x})" for p, k, a, x in presets.ASSETS) + ") s(profile, key, asset, pct)"


@query(f"select id, profile, key, asset, round(p.amount * pct / 100, 4) amount from ({SQL['plan_investment']}) p join {_SPLIT} using (profile, key) where p.error_code is null")
def plan_investment_assets(spark: SparkSession, d: str) -> DataFrame:
    return P.assets(P.plan_investment(_incomes(spark, d), presets.rules(spark, presets.INVESTMENT)), presets.asset_split(spark))


@query("select profile, cast(sum(rate) as double) target from (values " + ", ".join(f"('{p}', {r})" for p, rs in presets.TAX.items() for _, r, _, _ in rs) + ") t(profile, rate) group by 1")
def stat_tax_target(spark: SparkSession, d: str) -> DataFrame:
    return S.tax_targets(presets.tax_rules(spark))


@query("select c_custkey id, domain, case when c_acctbal >= 0 then round(c_acctbal * rate / 100, 4) end tax, case when c_acctbal < 0 then 'InvalidAmount' end error_code from customer, (values ('Income', 10.0), ('CapitalGains', 15.0), ('Insurance', 5.0)) t(domain, rate)")
def tax_by_domain(spark: SparkSession, d: str) -> DataFrame:
    return L.tax_by_domain(_incomes(spark, d), presets.tax_rules(spark))


_LOAN = """(select c_custkey req_id, abs(c_acctbal) * 10 inc, cast(c_custkey % 1000 as double) ex, abs(c_acctbal) rq, 600 + c_custkey % 301 sc,
case c_mktsegment when 'AUTOMOBILE' then 'Personal' when 'BUILDING' then 'Home' when 'FURNITURE' then 'Business' when 'HOUSEHOLD' then 'Education' else 'Personal' end purpose, c_custkey % 2 = 0 joint from customer)"""


def _approved(pol: str, mx: float, su: float, jb: bool, bus: bool, per: bool) -> str:
    return f"""select req_id, '{pol}' policy, err is null approved, round(case when err is null then eff * {mx} / 100 else 0.0 end, 4) max_allowed_emi, cast(case when err is null then (case when sc between 750 and 900 then 0.1 when sc between 650 and 749 then 0.3 else 0.6 end) else 0.7 end as double) risk_score, coalesce(err, 'Approved') reason from
(select *, case when inc <= 0 then 'InvalidInput' when purpose = 'Business' and not {str(bus).lower()} then 'ProfileInvariantViolated' when purpose = 'Personal' and not {str(per).lower()} then 'ProfileInvariantViolated' when eff <= 0 then 'InvalidIncome'
 when rq <= 0 then 'InvalidEmi' when rq / eff * 100 > {mx} then 'EmiTooHigh' when 100 - rq / eff * 100 < {su} then 'InsufficientSurplus' end err from (select *, inc - ex + case when joint and {str(jb).lower()} then inc else 0 end eff from {_LOAN}))"""


@query(" union all ".join(_approved(p, presets.EMI_POLICY[p][0], presets.EMI_POLICY[p][1], presets.EMI_POLICY[p][3], *presets.LOAN_POLICY[p]) for p in presets.EMI_POLICY))
def loan_assessment(spark: SparkSession, d: str) -> DataFrame:
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    purpose = F.when(segment == "BUILDING", "Home").when(segment == "FURNITURE", "Business").when(segment == "HOUSEHOLD", "Education").otherwise("Personal")
    base = T.table(spark, d, "customer").select(
        key.alias("req_id"), (F.abs("c_acctbal") * 10).alias("monthly_income"), (key % 1000).cast("double").alias("existing_emi"), F.abs("c_acctbal").alias("requested_emi"), (600 + key % 301).alias("credit_score"), purpose.alias("purpose"), (key % 2 == 0).alias("is_joint")
    )
    return L.assess_loans(L.by_policy(base, presets.emi_policies(spark)), ("policy",))


@query("select c_custkey id, case when c_acctbal >= 0 then round(c_acctbal * 12 * 1.2, 4) end fund, case when c_acctbal < 0 then 'NegativeExpense' end error_code from customer")
def emergency_fund(spark: SparkSession, d: str) -> DataFrame:
    months, times, _, _ = presets.FINANCE_POLICY["conservative"]
    return L.emergency_funds(T.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("expense"), F.lit(months).alias("months"), F.lit(times).alias("multiplier")))


@query("""select c_custkey id, case when m > 0 and c_acctbal >= 0 then round(list_reduce(list_prepend(0.0::double, list_transform(generate_series(1, m), lambda i: c_acctbal)), lambda t, c: t * (1 + 0.04 / 12) + c), 4) end projected,
case when m <= 0 or c_acctbal < 0 then 'InvalidInput' end error_code from (select *, c_custkey % 25 m from customer)""")
def savings_projection(spark: SparkSession, d: str) -> DataFrame:
    x = T.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 25).cast("int").alias("months"), F.col("c_acctbal").alias("contribution"), F.lit(0.04).alias("growth_frac"))
    return L.savings_projections(x)


# --- scores, vectors, text ------------------------------------------------------------------------


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    """Two metrics a customer: balance against a target, and one without target."""
    key, bal = F.col("c_custkey"), F.col("c_acctbal")
    rows = F.array(
        F.struct(F.lit(0).alias("metric_idx"), F.lit("Balance").alias("name"), F.lit("Wealth").alias("category"), F.abs(bal).alias("value"), F.lit(5000.0).alias("target"), F.lit(0.7).alias("weight"), F.array(F.abs(bal) * 0.5, F.abs(bal)).alias("history")),
        F.struct(F.lit(1).alias("metric_idx"), F.lit("Orders").alias("name"), F.lit("Activity").alias("category"), (key % 10).cast("double").alias("value"), F.lit(None).cast("double").alias("target"), F.lit(0.4).alias("weight"), F.array((key % 3).cast("double"), (key % 10).cast("double")).alias("history")),
    )
    return T.table(spark, d, "customer").select(key.alias("profile_id"), F.explode(rows).alias("m")).select("profile_id", "m.*")


@query("select c_custkey profile_id, 'Wealth' category, round(least(greatest(1 - abs(abs(c_acctbal) - 5000.0) / 5000.0, 0.0) * 0.7, 1.0) * 100, 6) score, cast(null as varchar) error_code from customer union all select c_custkey, 'Activity', 40.0, null from customer")
def stat_scores(spark: SparkSession, d: str) -> DataFrame:
    return S.stat_scores(_metrics(spark, d))


@query("""with m as (select c_custkey id, abs(c_acctbal) v, abs(abs(c_acctbal) - 5000.0) / 5000.0 * 100 off, cast(c_custkey % 3 as double) a, cast(c_custkey % 10 as double) b from customer)
select id profile_id, 0 metric_idx, 'target' kind, case when off >= 15.0 then 'Critical' else 'Warning' end severity, round(off, 6) pct from m where off >= 5.0
union all select id, 0, 'trend', 'Warning', 100.0 from m
union all select id, 1, 'trend', 'Warning', round(case when a = 0 then 100.0 else abs(b - a) / a * 100 end, 6) from m where case when a = 0 then 100.0 else abs(b - a) / a * 100 end >= 10.0""")
def stat_alerts(spark: SparkSession, d: str) -> DataFrame:
    return S.stat_alerts(_metrics(spark, d), *presets.ALERT_POLICY["strict"]).drop("message")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with the next one by id."""
    v = T.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return v.select(F.col("vec_id").alias("a_id"), F.col("v").alias("a"), (F.col("vec_id") + 1).alias("b_id")).join(v.select(F.col("vec_id").alias("b_id"), F.col("v").alias("b")), "b_id")


_VEC = "(select x.vec_id a_id, y.vec_id b_id, cast(x.embedding as double[]) a, cast(y.embedding as double[]) b from embeddings x join embeddings y on y.vec_id = x.vec_id + 1)"


@query(f"select a_id, b_id, round(list_distance(a, b), 6) score, cast(null as varchar) error_code from {_VEC}")
def similarity_euclidean(spark: SparkSession, d: str) -> DataFrame:
    return S.similarity(_pairs(spark, d), "Euclidean")


@query(f"select a_id, b_id, round(list_cosine_similarity(a, b), 6) score, cast(null as varchar) error_code from {_VEC}")
def similarity_cosine(spark: SparkSession, d: str) -> DataFrame:
    return S.similarity(_pairs(spark, d), "Cosine")


@query(f"""with p as (select *, list_avg(a) ma, list_avg(b) mb from {_VEC}), q as (select a_id, b_id, list_transform(a, lambda x: x - ma) a, list_transform(b, lambda x: x - mb) b from p)
select a_id, b_id, round(list_cosine_similarity(a, b), 6) score, cast(null as varchar) error_code from q""")
def similarity_pearson(spark: SparkSession, d: str) -> DataFrame:
    return S.similarity(_pairs(spark, d), "Pearson")


def _chat(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


@query("select session_id, seq, role, content from (select conv_id session_id, turn seq, role, text content, row_number() over (partition by conv_id order by turn desc) rn from conversations) where rn <= 20")
def chat_last_n(spark: SparkSession, d: str) -> DataFrame:
    return X.last_messages(_chat(spark, d))


@query("""select session_id, 'You are a finance assistant. Use tools for math.' || chr(10) || chr(10) || string_agg(upper(role[1]) || lower(role[2:]) || ': ' || content, chr(10) order by seq) || chr(10) || 'User: What next?' || chr(10) prompt
from (select conv_id session_id, turn seq, role, text content, row_number() over (partition by conv_id order by turn desc) rn from conversations) where rn <= 3 group by 1""")
def chat_prompt(spark: SparkSession, d: str) -> DataFrame:
    return X.chat_prompt(_chat(spark, d), F.lit("What next?"), 3)


@query("select doc_id, case when text is null or trim(translate(text, chr(10) || chr(13) || chr(9), '   ')) = '' then 'EmptyPrompt' when contains(text, 'calculate') or contains(text, 'emi') then 'UseTool' end error_code from documents")
def prompt_guard(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "documents").select("doc_id", X.prompt_error(F.col("text")).alias("error_code"))


@query("select doc_id, case when text is null or trim(translate(text, chr(10) || chr(13) || chr(9), '   ')) = '' then 'EmptyText' when regexp_full_match(text, '[0-9\\s]+') then 'NumericOnly' when strlen(text) > 8000 then 'TooLong' end error_code from documents")
def embedding_guard(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "documents").select("doc_id", X.embedding_error(F.col("text")).alias("error_code"))


@query()
def tool_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """JSON calls made from customers, of every tool and an unknown one; no SQL."""
    key, bal = F.col("c_custkey"), F.col("c_acctbal")
    made = {
        "calculate_emi": F.to_json(F.struct((F.abs(bal) * 100).alias("principal"), F.lit(10.0).alias("annual_rate"), F.lit(24).alias("tenure_months"))),
        "assess_loan": F.to_json(F.struct(F.struct((F.abs(bal) * 10).alias("monthly_income"), F.abs(bal).alias("requested_emi"), F.lit(760).alias("credit_score"), F.lit("Home").alias("purpose")).alias("request"), F.lit("salaried").alias("policy"))),
        "emergency_fund": F.to_json(F.struct(bal.alias("monthly_expense"), F.lit("default").alias("policy"))),
        "savings_projection": F.to_json(F.struct((key % 25).alias("months"), F.lit("conservative").alias("policy"))),
        "calculate_tax": F.to_json(F.struct(bal.alias("amount"), F.lit("simple_income_tax").alias("profile"))),
        "generate_investment_plan": F.to_json(F.struct(bal.alias("investable_amount"), F.lit("growing_family_balanced").alias("profile"))),
        "generate_cashflow": F.to_json(F.struct(bal.alias("monthly_income"), F.lit("family").alias("profile"))),
        "generate_budget": F.to_json(F.struct(bal.alias("monthly_income"), F.lit("single_parent").alias("profile"))),
        "profile_similarity": F.to_json(F.struct(F.struct(F.array(bal, key.cast("double")).alias("metrics")).alias("a"), F.struct(F.array(F.lit(1.0), F.lit(2.0)).alias("metrics")).alias("b"), F.lit("Cosine").alias("metric"))),
        "stat_analysis": F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("Balance").alias("name"), F.lit("Wealth").alias("category"), F.abs(bal).alias("value"), F.lit(5000.0).alias("target"), F.lit(0.7).alias("weight"), F.array(F.lit(1.0), F.abs(bal)).alias("history"))).alias("metrics")).alias("profile"))),
        "no_such_tool": F.lit("{}"),
    }
    calls = [F.struct((key * 100 + i).alias("call_id"), F.lit(k).alias("tool"), v.alias("args")) for i, (k, v) in enumerate(made.items())]
    return tools.execute(T.table(spark, d, "customer").select(F.explode(F.array(*calls)).alias("c")).select("c.*"))
