"""Sketches stored per batch and merged for longer spans, each answer held against the whole rows.

Answers of sketches differ in their last digits from run to run, so a query
returns whether each lies inside its stated bound, beside what is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import sketches as S
from ..sources import sinks as K
from .registry import query


def kept(t, monthly: DataFrame, cut: Column) -> DataFrame:
    """Sketches stored as two batches, the second one twice, and read back."""
    path = K.scratch(t.spark, "sketches")
    for batch, part in (("01", cut), ("02", ~cut), ("02", ~cut)):
        S.keep_sketches(monthly.where(part), path, batch)
    return S.read_sketches(t.spark, path)


def ranks_hold(rows: DataFrame, found: DataFrame, keys: list[str], value: str, answers: dict[str, float]) -> DataFrame:
    """Per key and answer: the exact rank of the value is within the bound of the one asked for."""
    both = rows.select(*keys, value).join(F.broadcast(found), keys)
    n, bound = F.count(value), S.rank_error()
    held = [((F.count_if(F.col(value) < F.col(a)) / n <= q + bound) & (F.count_if(F.col(value) <= F.col(a)) / n >= q - bound)).alias(a)
            for a, q in answers.items()]
    return both.groupBy(*keys).agg(n.alias("n"), *held)


@query("AGG-07-sketch", """
    SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) AS n_values, true AS p05, true AS median, true AS p95 FROM lineitem GROUP BY 1, 2""")
def merged_quantiles(t):
    """Prices by month, kept in two batches, merged to quantiles of the whole time."""
    keys = ["l_returnflag", "l_linestatus"]
    rows = t.lineitem.withColumn("month", F.trunc(F.col("l_shipdate").cast("date"), "month"))
    monthly = S.sketch_rows(rows, [*keys, "month"], {"price": "l_extendedprice"})
    whole = S.merge_sketches(kept(t, monthly, F.month("month") <= 6), keys)
    asked = {"p05": 0.05, "median": 0.5, "p95": 0.95}
    found = whole.select(*keys, S.values("price").alias("n_values"), *[S.quantile("price", q).alias(a) for a, q in asked.items()])
    return ranks_hold(rows, found.drop("n_values"), keys, "l_extendedprice", asked).join(found.select(*keys, "n_values"), keys)


@query("Q-26-sketch", """
    SELECT rcp, period, count(*) AS n, true AS median FROM projections GROUP BY 1, 2""", ("projections",))
def merged_spread(t):
    """Median projection per scenario and period out of sketches per station, season and variable."""
    rows = t.projections
    fine = S.sketch_rows(rows, ["station_name", "rcp", "period", "variable", "time_aggregation"], {"value": "value"})
    found = S.merge_sketches(fine, ["rcp", "period"]).select("rcp", "period", S.quantile("value", 0.5).alias("median"))
    return ranks_hold(rows, found, ["rcp", "period"], "value", {"median": 0.5})


@query("AGG-04-sketch", """
    SELECT o_orderstatus, year(o_orderdate) AS year, count(*) AS n_rows, count(DISTINCT CAST(o_orderdate AS DATE)) AS days, true AS customers
    FROM orders GROUP BY 1, 2""")
def merged_distinct(t):
    """Months to years: distinct days are few and so exact, distinct customers are within the bound."""
    rows = t.orders.withColumns({"day": F.col("o_orderdate").cast("date"), "year": F.year("o_orderdate").cast("long"), "month": F.month("o_orderdate")})
    monthly = S.sketch_rows(rows, ["o_orderstatus", "year", "month"], distinct={"days": ("day", None), "customers": ("o_custkey", None)})
    keys = ["o_orderstatus", "year"]
    yearly = S.merge_sketches(kept(t, monthly, F.col("month") <= 3), keys).select(
        *keys, "n_rows", S.distinct("days").alias("days"), S.distinct("customers").alias("_found"))
    exact = rows.select(*keys, "o_custkey").distinct().groupBy(*keys).agg(F.count("o_custkey").alias("_exact"))
    near = F.abs(F.col("_found") - F.col("_exact")) <= S.distinct_error() * F.col("_exact")
    return yearly.join(exact, keys).select(*keys, "n_rows", "days", near.alias("customers"))


@query("AGG-03-sketch", "SELECT l_linestatus, count(*) AS n_rows, true AS cheap, true AS any, true AS both, true AS only_returned FROM lineitem GROUP BY 1")
def conditions_combined(t):
    """Parts that were sold cheaply, returned, both, or returned and never cheap: set operations on sketches of quarters."""
    cheap, returned = F.col("l_discount") > 0.05, F.col("l_returnflag") == "R"
    rows = t.lineitem.withColumn("quarter", F.quarter("l_shipdate"))
    quarterly = S.sketch_rows(rows, ["l_linestatus", "l_returnflag", "quarter"], distinct={"cheap": ("l_partkey", cheap), "returned": ("l_partkey", returned)})
    found = S.merge_sketches(kept(t, quarterly, F.col("quarter") < 3), ["l_linestatus"]).select(
        "l_linestatus", "n_rows", S.distinct("cheap").alias("_cheap"), S.distinct_of("any", "cheap", "returned").alias("_any"),
        S.distinct_of("all", "cheap", "returned").alias("_both"), S.distinct_of("first", "returned", "cheap").alias("_only"))
    part = rows.groupBy("l_linestatus", "l_partkey").agg(F.max(cheap).alias("c"), F.max(returned).alias("r"))
    exact = part.groupBy("l_linestatus").agg(F.count_if("c").alias("xc"), F.count_if(F.col("c") | F.col("r")).alias("xa"),
                                             F.count_if(F.col("c") & F.col("r")).alias("xb"), F.count_if(F.col("r") & ~F.col("c")).alias("xo"))
    bound = S.distinct_error() * F.col("xa")
    return found.join(exact, "l_linestatus").select("l_linestatus", "n_rows", *[(F.abs(F.col(a) - F.col(x)) <= bound).alias(n) for n, a, x in (
        ("cheap", "_cheap", "xc"), ("any", "_any", "xa"), ("both", "_both", "xb"), ("only_returned", "_only", "xo"))])
