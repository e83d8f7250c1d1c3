"""Set-based changes: append, upsert, delete, JSON rows. Each is a plan; the caller writes it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert(current: DataFrame, changes: DataFrame, key: str = "tx_id", owner: str = "user_id") -> DataFrame:
    """Rows of current with same key and owner are replaced; other changes are added only where no other owner has the key."""
    kept = current.join(changes.select(key, owner), [key, owner], "left_anti")
    foreign = current.join(changes.select(key, F.col(owner).alias("__owner")), key).where(F.col(owner) != F.col("__owner")).select(key).distinct()
    return kept.unionByName(changes.join(foreign, key, "left_anti"))


def upsert_budgets(current: DataFrame, new: DataFrame) -> DataFrame:
    """A new budget that meets one of its user and category in time replaces that one's amount and times, else it is added.

    Of several that it meets the one with the least budget_id changes; of several new ones that meet the same, the one with the
    greatest budget_id counts.
    """
    fields = ["amount", "start_date", "end_date"]
    b, n = current.alias("b"), new.alias("n")
    meets = (F.col("n.end_date").isNull() | (F.col("b.start_date") <= F.col("n.end_date"))) & (F.col("b.end_date").isNull() | (F.col("b.end_date") >= F.col("n.start_date")))
    same = (F.col("n.user_id") == F.col("b.user_id")) & (F.col("n.category") == F.col("b.category"))
    met = n.join(b, same & meets).groupBy(F.col("n.budget_id").alias("new_id")).agg(F.min("b.budget_id").alias("budget_id"), F.first(F.struct(*[f"n.{c}" for c in fields])).alias("to"))
    changes = met.groupBy("budget_id").agg(F.max_by("to", "new_id").alias("to"))
    kept = current.join(changes, "budget_id", "left").select(*[F.when(F.col("to").isNotNull(), F.col(f"to.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in current.columns])
    return kept.unionByName(new.join(met.select(F.col("new_id").alias("budget_id")), "budget_id", "left_anti").select(*current.columns))


def delete(current: DataFrame, gone: DataFrame, key: str = "tx_id", owner: str = "user_id") -> DataFrame:
    return current.join(gone.select(key, owner), [key, owner], "left_anti")


def insert_unique(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows whose key isn't there yet; of several new ones the least row wins."""
    one = new.groupBy(key).agg(F.min(F.struct(*new.columns)).alias("r")).select("r.*")
    return one.join(current.select(key), key, "left_anti")


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def chat_append(history: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages continue each session's sequence."""
    last = history.groupBy("session_id").agg(F.max("seq").alias("__last"))
    from pyspark.sql import Window

    order = Window.partitionBy("session_id").orderBy("ts", "role", "content")
    numbered = messages.withColumn("__n", F.row_number().over(order)).join(last, "session_id", "left")
    return history.unionByName(numbered.select("session_id", (F.coalesce(F.col("__last"), F.lit(-1)) + F.col("__n")).cast("int").alias("seq"), "role", "content", "ts"))
