"""Canonical tables: schemas, validation, and adapters from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions.amounts import MOST

TRANSACTIONS = (
    "tx_id bigint, user_id bigint, ts timestamp, price double, category string, name string, description string, "
    "is_recurring boolean, recurring_frequency string, last_generated_at timestamp, "
    "emi_meta struct<principal: double, annual_rate: double, tenure_months: int, original_tenure: int>"
)
BUDGETS = "budget_id bigint, user_id bigint, category string, amount double, start_date timestamp, end_date timestamp, is_recurring boolean, created_at timestamp"
FREQUENCIES = ("Daily", "Weekly", "Monthly")
DEFAULT_CATEGORY, MISSING_CATEGORY, OVERALL = "General", "Uncategorized", "Overall"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_defaults(raw: DataFrame) -> DataFrame:
    """Write-time defaults of transactions."""
    return raw.withColumns({"category": F.coalesce("category", F.lit(DEFAULT_CATEGORY)), "is_recurring": F.coalesce("is_recurring", F.lit(False))})


def reject_reason(required: tuple[str, ...] = ("tx_id", "user_id", "ts", "price")) -> Column:
    """Why a transaction can't be stored; null if it can. NaN, infinite and huge prices are invalid."""
    out = F.when(F.col("is_recurring") & ~F.coalesce(F.col("recurring_frequency").isin(*FREQUENCIES), F.lit(False)), F.lit("bad_frequency"))
    out = out.when(~(F.abs("price") < MOST), F.lit("bad_price"))
    for c in required:
        out = out.when(F.col(c).isNull(), F.lit(f"missing_{c}"))
    return out


def validate_transactions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows with defaults, and rejected ones with their reason."""
    judged = with_defaults(raw).withColumn("reason", reject_reason())
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def owned(df: DataFrame, key: int, owner: int, id_column: str = "tx_id") -> DataFrame:
    """The row of an id, if it is the owner's."""
    return df.where((F.col(id_column) == key) & (F.col("user_id") == owner))


def newest_first(budgets: DataFrame) -> DataFrame:
    """Budgets by creation, the newest first; equal times by id."""
    return budgets.orderBy(F.desc("created_at"), "budget_id")


def receipts(tx: DataFrame) -> DataFrame:
    """What a receipt shows of each transaction: its kind, magnitude with two decimals, date and texts."""
    kind = F.when(F.col("price") > 0, "Income").otherwise("Expense")
    return tx.select("tx_id", "user_id", kind.alias("kind"), F.format_string("₹%.2f", F.abs("price")).alias("amount"), F.date_format("ts", "yyyy-MM-dd").alias("date"), "category", F.coalesce("description", F.lit("")).alias("description"))


def feedback_error(fields: tuple[str, ...] = ("name", "email", "message")) -> Column:
    """The first required field that is missing or blank; null if none is."""
    return F.coalesce(*[F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(f"missing_{c}")) for c in fields])


def order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day-grained transactions from orders: open orders are income."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("tx_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"),
        F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).otherwise(-F.col("o_totalprice")).alias("price"),
        F.col("o_orderpriority").alias("category"), F.col("o_orderpriority").alias("description"),
    )


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intra-day transactions from events: sign-ups and views are income."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("tx_id"), "user_id", "ts",
        F.when(F.col("event_type").isin("signup", "view"), F.col("value")).otherwise(-F.col("value")).alias("price"),
        F.col("event_type").alias("category"), F.col("props").alias("description"),
    )


def customer_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("budget_id"), key.alias("user_id"), F.when(key % 2 == 0, F.lit(OVERALL)).otherwise(F.lit("1-URGENT")).alias("category"), F.abs("c_acctbal").alias("amount"),
        F.lit("1997-01-01").cast("timestamp_ntz").alias("start_date"), F.when(key % 3 == 0, F.lit(None)).otherwise(F.lit("1999-12-31")).cast("timestamp_ntz").alias("end_date"),
    )


def lineitem_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("bigint").alias("line"), F.col("l_extendedprice").alias("principal"),
        F.round(F.col("l_discount") * 100, 6).alias("rate_pct"), F.col("l_quantity").cast("int").alias("months"), F.col("l_shipdate").alias("ts"),
    )


def order_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurring templates from orders, with instalment plans on every fourth."""
    key = F.col("tx_id")
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("Daily", "Weekly", "Monthly", "Once")]), (key % 4).cast("int") + 1)
    return order_transactions(spark, sf_dir).select(
        "tx_id", "user_id", "ts", "price", "category", kinds.alias("recurring_frequency"), F.when(key % 5 == 0, F.lit(None)).otherwise(F.col("ts") + F.expr("interval 40 days")).alias("last_generated_at"),
        F.when(key % 8 == 2, F.struct(F.abs("price").alias("principal"), F.lit(12.0).alias("annual_rate"), (key % 3).cast("int").alias("tenure_months"), F.lit(12).alias("original_tenure"))).alias("emi_meta"),
    )
