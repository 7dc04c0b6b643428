"""Grouped statistics: conditional distinct counts, pivots, medians, coverage, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import scratch

#: Parts of a quantile's bracket, of which one is put in order.
SLICES = 64


def summarise(df: DataFrame, keys: list[str], spec: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in spec.items()])


def conditional_distinct(df: DataFrame, keys: list[str], conds: dict[str, Column], value: str,
                         total: str | None = None) -> DataFrame:
    """Distinct ``value`` count per key for each condition.

    One pass to (keys, value) with a flag per condition, then sums of flags:
    no row is copied per condition, and a hot key is spread by its values.
    """
    flags = [F.max(F.when(F.coalesce(c, F.lit(False)) & F.col(value).isNotNull(), 1).otherwise(0)).alias(n)
             for n, c in conds.items()]
    once = df.groupBy(*keys, value).agg(*flags) if flags else df.select(*keys, value).distinct()
    out = [F.sum(n).cast("long").alias(n) for n in conds]
    if total:
        out.append(F.count(value).alias(total))
    return once.groupBy(*keys).agg(*out)


def distinct_count(df: DataFrame, keys: list[str], value: str, name: str, approximate: bool = False) -> DataFrame:
    if approximate:
        return df.groupBy(*keys).agg(F.approx_count_distinct(value).alias(name))
    return df.select(*keys, value).distinct().groupBy(*keys).agg(F.count(value).alias(name))


def pivot_max(df: DataFrame, keys: list[str], conds: dict[str, Column], value: str) -> DataFrame:
    """One column per condition: the largest value of the rows that meet it."""
    return df.groupBy(*keys).agg(*[F.max(F.when(c, F.col(value))).alias(n) for n, c in conds.items()])


def pivot_first(df: DataFrame, keys: list[str], code: str, value: str, mapping: dict[str, str],
                order: list[str]) -> DataFrame:
    """One column per known code: its first non-null value by ``order``; codes never seen give NULL."""
    rank = F.struct(*order)
    cols = [F.min_by(F.when(F.col(code) == c, F.col(value)),
                     F.when((F.col(code) == c) & F.col(value).isNotNull(), rank)).alias(n)
            for c, n in mapping.items()]
    return df.groupBy(*keys).agg(*cols)


def discrete_quantile(df: DataFrame, keys: list[str], value: str, q: float = 0.5, name: str = "quantile",
                      accuracy: int = 10_000, also: list[Column] | None = None) -> DataFrame:
    """Exact ``percentile_disc`` per key for groups of any size, in two passes over the rows.

    A quantile sketch brackets the answer (its rank error is at most
    n / accuracy), rows under the bracket are only counted, and just the
    distinct values inside it are written and ranked: their counts per slice of
    the bracket tell the slice of the answer, and only that slice is put in
    order. An answer outside the bracket is an error. ``also``: aggregates of
    the first pass that come with the result. NULL values do not count.
    """
    # ``accuracy`` bounds the sketch's rank error; twice that on each side is safe.
    span = 2.0 / accuracy
    lo, hi = max(0.0, q - span), min(1.0, q + span)
    ends = [F.min(value), F.max(value)]
    sketch = F.percentile_approx(value, [lo, hi], accuracy)
    bracket = _kept(df.groupBy(*keys).agg(F.count(value).alias("_n"), (ends[0] if lo == 0.0 else sketch[0]).alias("_lo"),
                                          (ends[1] if hi == 1.0 else sketch[1]).alias("_hi"), *(also or [])).where("_n > 0"), "bracket")
    limits = bracket.select(*keys, "_n", "_lo", "_hi")
    near = df.select(*keys, value).join(limits, keys).where(F.col(value) <= F.col("_hi"))
    # Values below the bracket collapse to one entry, slice -1.
    inside = F.col(value) >= F.col("_lo")
    share = (F.col(value).cast("double") - F.col("_lo").cast("double")) / F.nullif(F.col("_hi").cast("double") - F.col("_lo").cast("double"), F.lit(0.0))
    part = F.when(inside, F.greatest(F.lit(0), F.least(F.lit(SLICES - 1), F.coalesce(F.floor(share * SLICES), F.lit(0))))).otherwise(-1)
    counts = _kept(near.groupBy(*keys, "_n", part.alias("_s"), F.when(inside, F.col(value)).alias("_v")).agg(F.count("*").alias("_c")), "counts")
    target = F.greatest(F.ceil(F.col("_n") * F.lit(q)), F.lit(1))
    per = Window.partitionBy(*keys)
    slices = (counts.groupBy(*keys, "_n", "_s").agg(F.sum("_c").alias("_c"))
              .withColumns({"_cum": F.sum("_c").over(per.orderBy("_s")), "_all": F.sum("_c").over(per)}))
    lost = (F.col("_all") < target) | ((F.col("_s") == -1) & (F.col("_cum") >= target))
    rest = F.when(lost, F.raise_error(F.lit("discrete_quantile: the sketch missed the answer; raise accuracy"))).otherwise(target - F.col("_cum") + F.col("_c"))
    hit = (slices.where((F.col("_cum") >= target) & (F.col("_cum") - F.col("_c") < target) | lost)
           .select(*keys, F.col("_s").alias("_hit"), rest.cast("long").alias("_rest")))
    ranked = counts.join(hit, keys).where("_s = _hit").withColumn("_cum", F.sum("_c").over(per.orderBy("_v")))
    best = ranked.where("_cum >= _rest").groupBy(*keys).agg(F.min("_v").alias(name))
    return best.join(bracket.drop("_n", "_lo", "_hi"), keys) if also else best


def _kept(df: DataFrame, name: str) -> DataFrame:
    """A small result, written once for the steps that need it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, keys: list[str], value: str, members: str | None = None, digits: int = 2,
           exact: bool = False) -> DataFrame:
    """Median, min and max (and distinct members) per key."""
    aggs = [F.round(F.min(value), digits).alias("min_value"), F.round(F.max(value), digits).alias("max_value")]
    if exact:
        out = discrete_quantile(df, keys, value, 0.5, "median_value", also=aggs)
        out = out.withColumn("median_value", F.round("median_value", digits))
    else:
        out = df.groupBy(*keys).agg(F.round(F.percentile_approx(value, 0.5), digits).alias("median_value"), *aggs)
    if members:
        out = out.join(distinct_count(df, keys, members, "n_members"), keys)
    return out


def median_then_pivot(df: DataFrame, keys: list[str], by: list[str], value: str,
                      conds: dict[str, Column], exact: bool = False) -> DataFrame:
    """Median per (keys, by), then one column per condition on ``by``."""
    if exact:
        med = discrete_quantile(df, [*keys, *by], value, 0.5, "_median")
    else:
        med = df.groupBy(*keys, *by).agg(F.percentile_approx(value, 0.5).alias("_median"))
    return pivot_max(med, keys, conds, "_median")


def coverage(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Rows and distinct counts per key, one de-duplicated pass per column."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    for c in cols:
        out = out.join(distinct_count(df, keys, c, f"n_{c}"), keys)
    return out


def centroids(cells: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    return cells.groupBy(key).agg(F.avg(lat).alias("lat"), F.avg(lon).alias("lon"))


def latency_summary(df: DataFrame, group: str, ms: str, ts: list[str], last_n: int = 100) -> DataFrame:
    """Count, mean, extremes and p95 per group over the newest ``last_n`` rows.

    p95 is the element at index int(0.95 * n) of the sorted values; the arrays
    are bounded by ``last_n``. The mean is cut to six digits before it is
    rounded, so the order of the sum cannot tip a tie.
    """
    recent = df.orderBy(*[F.desc(c) for c in ts]).limit(last_n)
    values = F.array_sort(F.collect_list(ms))
    return (recent.groupBy(group)
            .agg(F.count("*").alias("n"), F.bround(F.round(F.avg(ms), 6), 1).alias("avg_ms"),
                 F.bround(F.max(ms), 1).alias("max_ms"), F.bround(F.min(ms), 1).alias("min_ms"),
                 values.alias("_v"))
            .withColumn("p95_ms", F.bround(F.get("_v", F.floor(F.col("n") * 0.95).cast("int")), 1))
            .drop("_v"))
