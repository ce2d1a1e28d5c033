"""The read side: predicates over notices and the marts built on them. as_of is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def days_until(due: Column, as_of: Column) -> Column:
    return F.datediff(due, as_of).cast("long")


def deadline_status(due: Column, as_of: Column) -> Column:
    d = days_until(due, as_of)
    return F.when(due.isNull(), "open").when(d < 0, "closed").when(d <= 7, "closing").otherwise("open")


def badge(due: Column, as_of: Column) -> tuple[Column, Column]:
    """Label and level."""
    d = days_until(due, as_of)
    label = F.when(due.isNull(), "unknown").when(d < 0, "closed").when(d == 0, "D-DAY").otherwise(F.concat(F.lit("D-"), d.cast("string")))
    level = F.when(due.isNull() | (d < 0), "none").when(d <= 3, "red").when(d <= 7, "orange").otherwise("blue")
    return label, level


def is_open(due: Column, as_of: Column) -> Column:
    """Compares the column itself, so that the scan can skip row groups."""
    return due.isNull() | (due >= as_of)


def is_new(first_seen: Column, as_of: Column, hours: int = 48) -> Column:
    return F.coalesce(first_seen > as_of - F.expr(f"INTERVAL {hours} HOURS"), F.lit(False))


def due_soon(due: Column, as_of: Column) -> Column:
    return F.coalesce(due.between(as_of, F.date_add(as_of, 7)), F.lit(False))


def region_matches(country: Column, choice: str, home: str) -> Column:
    if choice == "domestic":
        return country == home
    if choice == "overseas":
        return (country != "") & (country != home)
    return F.lit(True)


def zero_filled_days(counts: DataFrame, day: str, n: str, first: str, last: str) -> DataFrame:
    """A row for every day of the range, with 0 where there is no count."""
    spark = counts.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(day))
    return spine.join(counts, day, "left").select(day, F.coalesce(n, F.lit(0).cast("long")).alias(n))


def share_percent(counts: DataFrame, n: str) -> DataFrame:
    """Whole percent of the total, 0 if that is 0; for tables of counts, which are as small as their keys are few."""
    total = F.sum(n).over(Window.partitionBy())
    return counts.withColumn("share_pct", F.when(total > 0, F.floor(100 * F.col(n) / total + 0.5)).otherwise(0).cast("long"))


def ratio_to_max(counts: DataFrame, n: str) -> DataFrame:
    most = F.greatest(F.lit(1), F.max(n).over(Window.partitionBy()))
    return counts.withColumn("ratio_pct", F.floor(100 * F.col(n) / most + 0.5).cast("long"))


def shortlist(rows: DataFrame, key: str, due: str, new: Column, as_of: Column, n: int = 5) -> DataFrame:
    """New ones, then those due in 3, in 7 days, then the rest; in each the nearest first, unknown last."""
    d = days_until(F.col(due), as_of)
    rank = F.when(new, 0).when(d.between(0, 3), 1).when(d.between(0, 7), 2).otherwise(3)
    return rows.withColumns({"priority": rank, "days": d}).orderBy("priority", F.col("days").asc_nulls_last(), key).limit(n)


def region_bar(rows: DataFrame, country: Column, home: str) -> DataFrame:
    """(domestic, overseas, domestic_pct, overseas_pct): whole percents that add up to 100; without rows all is overseas."""
    n, own = F.count("*"), F.count_if(country == home)
    pct = F.when(n > 0, F.floor(100 * own / n + 0.5)).otherwise(0).cast("long")
    return rows.agg(own.alias("domestic"), (n - own).alias("overseas"), pct.alias("domestic_pct"), (100 - pct).cast("long").alias("overseas_pct"))


def calendar_items(rows: DataFrame, key: str, due: str) -> DataFrame:
    """Every distinct item with a due date, with the number of its day's items: a day's list is read by its date, and no day has to meet in one task."""
    items = rows.where(F.col(key).isNotNull() & F.col(due).isNotNull()).dropDuplicates([key])
    counts = items.groupBy(F.col(due).alias("_day")).agg(F.count("*").alias("day_n"))
    return items.join(counts, F.col(due) == F.col("_day")).drop("_day")


def calendar_page(spark: SparkSession, counts: DataFrame, month: str, today: str, selected: str | None) -> DataFrame:
    """A row for every day of the month: its number of items, urgency, whether it is today or selected, the blanks before the 1st (Sunday first), and the months before and after."""
    first, day = F.trunc(F.lit(month).cast("date"), "MM"), F.col("day")
    grid = spark.range(1).select(month_grid(month).alias("day"))
    rows = grid.join(counts.select("day", "n"), "day", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    chosen = F.coalesce(day == F.lit(selected).cast("date"), F.lit(False))
    return rows.select("day", "n", urgency(days_until(day, F.lit(today).cast("date")), F.col("n")).alias("urgency"), (day == F.lit(today).cast("date")).alias("today"), chosen.alias("selected"), (F.dayofweek(first) - 1).alias("blanks"), F.add_months(first, -1).alias("previous_month"), F.add_months(first, 1).alias("next_month"))


def month_grid(month: str) -> Column:
    first = F.lit(month).cast("date")
    return F.explode(F.sequence(F.trunc(first, "MM"), F.last_day(first)))


def urgency(least_days: Column, n: Column) -> Column:
    return F.when(n == 0, "none").when(least_days <= 3, "urgent").when(least_days <= 7, "soon").otherwise("normal")
