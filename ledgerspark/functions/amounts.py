"""Signed amounts: above zero is income, the rest is expense and reported as a magnitude."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From this magnitude on, as for NaN and infinities, a number is no amount.
MOST = 1e13


def cents(x: Column) -> Column:
    """Whole cents, half away from zero. Their sums are exact and stay in generated code, unlike wide decimals.

    What is no amount counts 0, so that one such row neither fails nor spoils a sum; ``reject_reason`` names these rows. Null stays null.
    """
    whole = F.when(x >= 0, F.floor(x * 100 + 0.5)).otherwise(-F.floor(-x * 100 + 0.5))
    return F.when(F.abs(x) < MOST, whole).when(x.isNotNull(), F.lit(0)).cast("bigint")


def units(c: Column) -> Column:
    return c / F.lit(100.0)


def income(price: Column) -> Column:
    """Cents of income, 0 for expense."""
    return F.when(price > 0, cents(price)).otherwise(F.lit(0).cast("bigint"))


def expense(price: Column) -> Column:
    """Cents of expense as a magnitude, 0 for income."""
    return F.when(price > 0, F.lit(0).cast("bigint")).otherwise(-cents(price))


def total_of(x: Column) -> Column:
    """Exact sum of amounts, as a double."""
    return units(F.sum(cents(x)))


def sums(price: str = "price") -> list[Column]:
    p = F.col(price)
    return [units(F.sum(income(p))).alias("income"), units(F.sum(expense(p))).alias("expense"), total_of(F.abs(p)).alias("total")]


def normal_amount(raw: Column) -> Column:
    """Text or number to a finite double, 0 otherwise."""
    x = raw.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)
