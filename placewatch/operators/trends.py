"""Questions over a daily history table: change, streaks, trailing averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _day(date: str) -> Column:
    return F.unix_date(F.col(date))


def trend(df: DataFrame, keys: list[str], date: str, col: str, days: int, today=None) -> DataFrame:
    """Rows of the last ``days`` days with the change to the previous row of the key."""
    end = F.lit(today).cast("date") if today is not None else df.agg(F.max(date)).scalar()
    recent = df.where(F.col(date) >= F.date_sub(end, days))
    previous = F.lag(col).over(Window.partitionBy(*keys).orderBy(date))
    return recent.withColumn("change", F.col(col) - previous)


def days_with(df: DataFrame, keys: list[str], date: str, cond: Column, more_than: int = 0,
              name: str = "n_days") -> DataFrame:
    """Keys with more than ``more_than`` distinct days on which ``cond`` holds."""
    days = df.where(cond).select(*keys, date).distinct()
    return days.groupBy(*keys).agg(F.count("*").alias(name)).where(F.col(name) > more_than)


def against_trailing(df: DataFrame, keys: list[str], date: str, col: str, days: int) -> DataFrame:
    """Each day next to the mean of the ``days`` days before it (by date, gaps allowed)."""
    w = Window.partitionBy(*keys).orderBy(_day(date)).rangeBetween(-days, -1)
    return df.withColumn("trailing_avg", F.round(F.avg(col).over(w), 4))


def level_against_period(current: DataFrame, history: DataFrame, key: str, date: str, col: str,
                         start, end) -> DataFrame:
    """Current rows with the mean of ``col`` over the history days in [start, end)."""
    past = (history.where((F.col(date) >= F.lit(start).cast("date")) & (F.col(date) < F.lit(end).cast("date")))
            .groupBy(key).agg(F.round(F.avg(col), 4).alias("period_avg")))
    return current.join(past, key, "left")
