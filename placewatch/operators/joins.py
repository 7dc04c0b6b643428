"""Joins: stars, key maps, cell containment, lookups, and a skew-safe equi-join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import tasks
from ..functions.scalars import padded_code
from ..sources.sinks import scratch

HOT_ROWS = 2_000_000   # rows of one key that one task should take at most
SALTS = 64


def star(base: DataFrame, dims: list[tuple[DataFrame, str]]) -> DataFrame:
    """Left-join dimensions in turn, each on a key column both sides have."""
    return reduce(lambda left, dim: left.join(dim[0], dim[1], "left"), dims, base)


def left_with(df: DataFrame, dim: DataFrame, on: dict[str, str], only: Column | str | None = None) -> DataFrame:
    """Left join on differently named keys; ``only`` limits the right rows, never the left ones."""
    if only is not None:
        dim = dim.where(only)
    cond = reduce(lambda a, b: a & b, [df[left] == dim[right] for left, right in on.items()])
    return df.join(dim, cond, "left").drop(*[dim[right] for left, right in on.items()])


def join_code(df: DataFrame, dim: DataFrame, left: str, right: str, width: int = 4, how: str = "left") -> DataFrame:
    """Join a numeric code to a text code: both become text of ``width`` with leading zeros."""
    cond = padded_code(df[left], width) == padded_code(dim[right], width)
    return df.join(dim, cond, how)


def hot_keys(df: DataFrame, key: str, rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``rows`` rows. At most len(df) / rows keys can be hot."""
    return df.groupBy(key).count().where(F.col("count") > rows).select(key)


def spread_join(big: DataFrame, small: DataFrame, key: str, spread_by: list[str], how: str = "inner",
                rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """Equi-join ``big`` with ``small`` that splits hot keys of ``big`` over ``salts`` tasks.

    Only the ``small`` rows of hot keys are repeated; all other keys join as usual.
    ``how`` may be inner, left (keeps all of ``big``), left_semi or left_anti. The
    hot keys are looked for once and written: a small table for both sides.
    """
    path = scratch(big.sparkSession, "hot-keys")
    hot_keys(big, key, rows).write.parquet(path)
    hot = big.sparkSession.read.schema(big.select(key).schema).parquet(path).withColumn("_hot", F.lit(True))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread_by), F.lit(salts))).otherwise(F.lit(0)).cast("long")
    left = big.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    zero = F.lit(0).cast("long")
    copies = F.when(F.col("_hot"), F.sequence(zero, F.lit(salts - 1).cast("long"))).otherwise(F.array(zero))
    right = small.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def pairs_join(left: DataFrame, right: DataFrame, key: str, salts: int = 8) -> DataFrame:
    """Inner equi-join whose result is far larger than its sides.

    Tasks are dealt by what they return, not by the few bytes they read: the
    rows of a key are cut into ``salts`` parts of the left side, each of which
    meets a copy of the key's right rows, over as many tasks as the session
    shuffles to. Spark would keep such small sides in the few tasks that read
    or broadcast them.
    """
    part = F.pmod(F.xxhash64(*left.columns), F.lit(salts))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    a = left.where(F.col(key).isNotNull()).withColumn("_salt", part).repartition(tasks(left.sparkSession), key, "_salt")
    b = right.where(F.col(key).isNotNull()).withColumn("_salt", parts).repartition(tasks(left.sparkSession), key, "_salt")
    return a.join(b.hint("merge"), [key, "_salt"]).drop("_salt")


def cell_join(cover: DataFrame, points: DataFrame, cell: str, how: str = "left", pairs: bool = False) -> DataFrame:
    """Places' cells against points' cells: containment as an equality of cell ids; ``pairs``: an inner join that returns many times its sides."""
    return pairs_join(cover, points, cell) if pairs else cover.join(points, cell, how)


def via_map(facts: DataFrame, mapping: DataFrame, map_key: str, fact_key: str) -> DataFrame:
    """key -> map -> facts, inner; the fact's own key column is dropped."""
    return mapping.join(facts, mapping[map_key] == facts[fact_key]).drop(facts[fact_key])


def full_outer_coalesce(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join; each key column is the first non-null of both sides."""
    return a.join(b, keys, "full_outer")


def bulk_lookup(keys: DataFrame, table: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows found for the keys, keys without a row)."""
    wanted = keys.select(key).distinct()
    return table.join(wanted, key, "left_semi"), wanted.join(table, key, "left_anti")


def attach_scalars(df: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Add each column of a one-row frame to every row, as scalar subqueries."""
    return df.select("*", *[aggregates.select(c).scalar().alias(c) for c in aggregates.columns])


def with_missing_error(left: DataFrame, right: DataFrame, key: str, message: Column) -> DataFrame:
    """Left join plus column ``error``: ``message`` where the key has no row on the right."""
    marked = right.withColumn("_found", F.lit(True))
    return (left.join(marked, key, "left")
            .withColumn("error", F.when(F.col("_found").isNull(), message)).drop("_found"))
