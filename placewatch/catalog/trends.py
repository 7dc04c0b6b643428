"""Trend questions on the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trends as T
from .registry import query


def per_day(t):
    return t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("AGG-18", """
    SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS n_days FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(DISTINCT CAST(ts AS DATE)) > 3""")
def active_days(t):
    return T.days_with(t.events.withColumn("day", F.to_date("ts")), ["user_id"], "day", F.col("event_type") == "purchase", 3)


@query("Q-21-events", """
    WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2),
    r AS (SELECT * FROM d WHERE day >= DATE '2024-01-20' - 7)
    SELECT event_type, strftime(day, '%Y-%m-%d') AS day, n, n - lag(n) OVER (PARTITION BY event_type ORDER BY day) AS change FROM r""")
def changes(t):
    return T.trend(per_day(t), ["event_type"], "day", "n", 7, "2024-01-20").drop("total")


@query("Q-23-events", """
    WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2)
    SELECT a.event_type, strftime(a.day, '%Y-%m-%d') AS day, a.n, a.total, round(avg(b.n), 4) AS trailing_avg
    FROM d a LEFT JOIN d b ON b.event_type = a.event_type AND b.day < a.day AND b.day >= a.day - 7 GROUP BY 1, 2, 3, 4""")
def trailing(t):
    return T.against_trailing(per_day(t), ["event_type"], "day", "n", 7)


@query("Q-24-events", """
    WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT c.event_type, c.n, a.period_avg FROM (SELECT event_type, n FROM d WHERE day = DATE '2024-01-20') c
    LEFT JOIN (SELECT event_type, round(avg(n), 4) AS period_avg FROM d WHERE day >= DATE '2024-01-13' AND day < DATE '2024-01-20' GROUP BY 1) a USING (event_type)""")
def level(t):
    days = per_day(t)
    now = days.where("day = DATE'2024-01-20'").select("event_type", "n")
    return T.level_against_period(now, days, "event_type", "day", "n", "2024-01-13", "2024-01-20")
