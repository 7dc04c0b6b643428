"""Quantile and distinct-count sketches kept per batch and merged for any span, without reading rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries of a quantile sketch's lowest level, and log2 of the hashes a distinct sketch keeps.
QUANTILE_K = 1000
DISTINCT_LOG = 12


def rank_error(k: int = QUANTILE_K) -> float:
    """Bound of a quantile's rank error as a share of n: twice the error that 99 of 100 answers keep."""
    return 2 * 2.296 / k ** 0.9021


def distinct_error(log: int = DISTINCT_LOG) -> float:
    """Bound of a distinct count's error as a share of the union it comes from: five standard deviations.

    Up to 2 ** log distinct values the count is exact.
    """
    return 5 / 2 ** (log / 2)


def sketch_rows(df: DataFrame, keys: list[str], quantiles: dict[str, str | Column] | None = None,
                distinct: dict[str, tuple[str | Column, Column | None]] | None = None) -> DataFrame:
    """One row per key: ``n_rows``, a ``<name>_q`` sketch per value and a ``<name>_d`` sketch per (value, condition).

    NULL and NaN values and rows without the condition do not count; a key
    without any is kept, with an empty or NULL sketch. Sketches combine before
    the shuffle, so a hot key sends one per task.
    """
    aggs = [F.count("*").alias("n_rows")]
    for name, value in (quantiles or {}).items():
        v = (F.col(value) if isinstance(value, str) else value).cast("double")
        aggs.append(F.kll_sketch_agg_double(F.when(~F.isnan(v), v), QUANTILE_K).alias(f"{name}_q"))
    for name, (value, cond) in (distinct or {}).items():
        v = (F.col(value) if isinstance(value, str) else value).cast("string")
        aggs.append(F.theta_sketch_agg(v if cond is None else F.when(cond, v), DISTINCT_LOG).alias(f"{name}_d"))
    return df.groupBy(*keys).agg(*aggs)


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser keys: days to months, places to states, batches to the whole history."""
    aggs = [F.sum("n_rows").alias("n_rows")]
    for c in sketches.columns:
        if c.endswith("_q"):
            aggs.append(F.kll_merge_agg_double(c, QUANTILE_K).alias(c))
        elif c.endswith("_d"):
            aggs.append(F.theta_union_agg(c, DISTINCT_LOG).alias(c))
    return sketches.groupBy(*keys).agg(*aggs)


def keep_sketches(sketches: DataFrame, path: str, batch: str) -> None:
    """Store a batch's sketches in a folder of its own; a repeated batch replaces it, so no row counts twice."""
    sketches.write.mode("overwrite").parquet(f"{path}/_batch={batch}")


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    """All batches with their names as ``_batch``; merge them over any keys."""
    found = spark.read.parquet(path).drop("_batch").schema
    return spark.read.schema(found.add("_batch", "string")).parquet(path)


def quantile(name: str, q: float) -> Column:
    """The value at rank ``q``; NULL for a sketch of no value."""
    sketch = F.col(f"{name}_q")
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(q)))


def values(name: str) -> Column:
    """How many values a quantile sketch has seen, exactly."""
    return F.coalesce(F.kll_sketch_get_n_double(f"{name}_q"), F.lit(0).cast("bigint"))


def distinct(name: str) -> Column:
    return F.coalesce(F.theta_sketch_estimate(f"{name}_d"), F.lit(0).cast("bigint"))


def distinct_of(how: str, *names: str) -> Column:
    """Distinct values in ``all`` of the named sketches, in ``any`` of them, or in the ``first`` and no other."""
    step = {"all": F.theta_intersection, "any": F.theta_union, "first": F.theta_difference}[how]
    out = F.col(f"{names[0]}_d")
    for other in names[1:]:
        out = step(out, F.col(f"{other}_d"))
    return F.coalesce(F.theta_sketch_estimate(out), F.lit(0).cast("bigint"))
