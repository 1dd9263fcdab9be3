"""Money reports: savings, summaries, recurring entries, sums in one currency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import half_up

#: How often an entry can recur, and the digits of currencies that have other than two.
FREQUENCIES = ("daily", "weekly", "biweekly", "monthly", "yearly")
DIGITS = {"JPY": 0}


def savings(rows: DataFrame, key: str, income: Column, expense: Column, amount: str) -> DataFrame:
    """(key, income, expense, savings, rate): rate is the percentage of the income that is saved, 0 without income."""
    total = lambda which: F.coalesce(F.sum(F.when(which, F.col(amount))).cast("double"), F.lit(0.0))
    sums = rows.groupBy(key).agg(total(income).alias("income"), total(expense).alias("expense")).withColumn("savings", F.col("income") - F.col("expense"))
    return sums.withColumn("rate", F.when(F.col("income") > 0, half_up(F.col("savings") / F.col("income") * 100, 2)).otherwise(0.0))


def summary(rows: DataFrame, income: Column, expense: Column, category: str, amount: str, budget: float, warning: float = 0.8, top: int = 5) -> DataFrame:
    """(item, key, amount) of a period: income, expense, the largest categories, and those that reach the warning's share of their budget."""
    total = lambda item, which: rows.agg(F.coalesce(F.sum(F.when(which, F.col(amount))).cast("double"), F.lit(0.0)).alias("amount")).select(F.lit(item).alias("item"), F.lit("").alias("key"), "amount")
    groups = rows.groupBy(F.col(category).alias("key")).agg(F.sum(amount).cast("double").alias("amount"))
    largest = groups.orderBy(F.desc("amount"), "key").limit(top).select(F.lit("top").alias("item"), "key", "amount")
    alerts = groups.filter(F.col("amount") >= warning * budget).select(F.lit("alert").alias("item"), "key", "amount")
    return total("income", income).unionByName(total("expense", expense)).unionByName(largest).unionByName(alerts)


def next_occurrence(last: Column, frequency: Column, every: Column) -> Column:
    """The date after `last`; a day that a month doesn't have runs over into the next one."""
    months = F.when(frequency == "monthly", every).otherwise(every * 12)
    over = F.date_add(F.add_months(F.trunc(last, "month"), months), F.dayofmonth(last) - 1)
    days = F.when(frequency == "daily", 1).when(frequency == "weekly", 7).when(frequency == "biweekly", 14)
    return F.when(days.isNotNull(), F.date_add(last, days * every)).otherwise(over)


def _open(rules: DataFrame, as_of: Column) -> DataFrame:
    """Rules (last, frequency, every, until) that have not ended, with their next date."""
    return rules.filter(F.col("until").isNull() | (F.col("until") >= as_of)).withColumn("next", next_occurrence(F.col("last"), F.col("frequency"), F.col("every")))


def due(rules: DataFrame, as_of: Column) -> DataFrame:
    """The rules whose next entry is due, with its date as next: one entry a rule and run, after which next is its last."""
    return _open(rules, as_of).filter(F.col("next") <= as_of)


def upcoming(rules: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """The rules whose next date is within so many days, with those days."""
    return _open(rules, as_of).withColumn("days", F.date_diff("next", as_of)).filter(F.col("days").between(0, days))


def rounded(amount: Column, currency: Column) -> Column:
    """The amount to the digits of its currency, halves upwards."""
    out = half_up(amount, 2)
    for digits in sorted(set(DIGITS.values())):
        out = F.when(currency.isin(*(c for c, d in DIGITS.items() if d == digits)), half_up(amount, digits)).otherwise(out)
    return out


def one_currency(rows: DataFrame, amount: str, currency: str = "currency") -> DataFrame:
    """(amount, currency): the sum of amounts of one currency; an error if there are several."""
    sums = rows.agg(F.sum(amount).alias("amount"), F.min(currency).alias("currency"), F.max(currency).alias("_other"))
    same = F.col("currency").eqNullSafe(F.col("_other"))
    checked = F.when(same, F.col("amount")).otherwise(F.raise_error(F.concat(F.lit("currencies differ: "), "currency", F.lit(" and "), "_other")))
    return sums.select(checked.alias("amount"), "currency")
