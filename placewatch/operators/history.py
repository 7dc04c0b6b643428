"""State out of append-only history: newest batch, newest event, nearest in time, upsert."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import as_col, moment, seconds


def latest_batch(df: DataFrame, batch_col: str = "_ingest_time", as_of=None, day_col: str = "_ingest_date") -> DataFrame:
    """All rows of the newest batch (not later than ``as_of``).

    The newest batch time is a scalar subquery, so the filter reaches the scan
    and no row is moved; a window over the whole table would go to one task.
    Tables kept in day folders (``append_batch``) are read by folder: first the
    newest day, then the newest time inside it.
    """
    seen = df if as_of is None else df.where(F.col(batch_col) <= moment(df, batch_col, as_of))
    if day_col in df.columns:
        if as_of is not None:
            seen = seen.where(F.col(day_col) <= F.to_date(moment(df, batch_col, as_of)))
        newest = F.col(day_col) == seen.agg(F.max(day_col)).scalar()
        df, seen = df.where(newest), seen.where(newest)
    return df.where(F.col(batch_col) == seen.agg(F.max(batch_col)).scalar())


def _best(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row per key with the smallest ``order``; combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, "_row.*")


def time_order(df: DataFrame, ts: str, at: Column, pick: str, ties: list[str] | None = None) -> Column:
    """Ordering whose smallest value marks the picked row; NULL where a row may not be picked."""
    tail = [F.col(ts), *[F.col(c) for c in ties or []]]
    if pick == "nearest":
        return F.struct(F.abs(seconds(ts) - seconds(at)).alias("d"), *tail)
    if pick == "last_before":
        return F.when(F.col(ts) <= at, F.struct((-F.unix_micros(F.col(ts).cast("timestamp"))).alias("d"), *tail))
    if pick == "first":
        return F.struct(*tail)
    raise ValueError(f"unknown pick: {pick}")


def nearest_in_time(df: DataFrame, keys: list[str], ts: str, now=None, pick: str = "nearest",
                    ties: list[str] | None = None) -> DataFrame:
    """One row per key by time.

    ``pick`` = ``nearest`` (smallest distance in whole seconds), ``last_before``
    (newest not after ``now``) or ``first`` (earliest). Ties go to the smallest
    ``ts``, then the smallest ``ties``.
    """
    at = moment(df, ts, now)
    if pick == "last_before":
        df = df.where(F.col(ts) <= at)
    return _best(df, keys, time_order(df, ts, at, pick, ties))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row per key with the largest ``order`` columns."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*")


def latest_event(df: DataFrame, keys: list[str], ts: str, action: str, keep: str = "ADD") -> DataFrame:
    """Pairs whose newest event is ``keep``. At one instant another action wins, then the largest row."""
    rest = [c for c in df.columns if c not in [*keys, ts, action]]
    ordered = df.withColumn("_undone", F.when(F.col(action) == keep, 0).otherwise(1))
    newest = latest_per_key(ordered, keys, [ts, "_undone", *rest])
    return newest.where(F.col(action) == keep).select(*df.columns)


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order_by: list[str] | None = None) -> DataFrame:
    """``target`` after a merge: source rows replace rows of the same key, new keys are added.

    With ``order_by`` the largest row per key of the source is used; without it
    a repeated key in the source is an error. NULL keys are equal to each other.
    """
    if order_by:
        source = latest_per_key(source, keys, order_by)
    else:
        rest = [c for c in source.columns if c not in keys]
        packed = source.groupBy(*keys).agg(F.count("*").alias("_n"), F.any_value(F.struct(*rest)).alias("_row"))
        checked = F.when(F.col("_n") == 1, F.col("_row")).otherwise(
            F.raise_error(F.lit("upsert: the source has more than one row for a key")))
        source = packed.select(*keys, checked.alias("_row")).select(*keys, "_row.*")
    source = source.select(*[F.col(c).alias(f"_new_{c}") for c in target.columns], F.lit(True).alias("_hit"))
    same = reduce(lambda a, b: a & b, [target[k].eqNullSafe(source[f"_new_{k}"]) for k in keys])
    both = target.join(source, same, "full_outer")
    return both.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in target.columns])


def within(ts: str, at: Column, hours: int = 24) -> Column:
    """True in the half-open interval [at, at + hours)."""
    return (F.col(ts) >= at) & (F.col(ts) < at + F.expr(f"INTERVAL {int(hours)} HOURS"))


def time_window(df: DataFrame, ts: str, now=None, hours: int = 24) -> DataFrame:
    return df.where(within(ts, moment(df, ts, now), hours))


def freshness(df: DataFrame, ts: str, now=None, hours: int = 24, name: str = "is_fresh") -> DataFrame:
    at = moment(df, ts, now)
    return df.withColumn(name, F.coalesce(F.col(ts) > at - F.expr(f"INTERVAL {int(hours)} HOURS"), F.lit(False)))


def _ordering(order: list[str | Column]) -> list[Column]:
    return [as_col(c) for c in order]


def top_per_key(df: DataFrame, keys: list[str], order: list[str | Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key. The rank filter is also applied before the shuffle."""
    name = rank or "_rank"
    w = Window.partitionBy(*keys).orderBy(*_ordering(order))
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def collect_top(df: DataFrame, keys: list[str], order: list[str | Column], k: int,
                fields: list[str], name: str) -> DataFrame:
    """Per key an array of at most ``k`` structs in ``order``."""
    ranked = top_per_key(df, keys, order, k, rank="_rank")
    packed = F.array_sort(F.collect_list(F.struct("_rank", F.struct(*fields).alias("v"))))
    return ranked.groupBy(*keys).agg(F.transform(packed, lambda s: s["v"]).alias(name))


def top(df: DataFrame, order: list[str | Column], k: int) -> DataFrame:
    return df.orderBy(*_ordering(order)).limit(k)


def positions(df: DataFrame, order: list[str | Column], name: str = "pos") -> DataFrame:
    """Place of every row in the whole order, from 1. Rows are sorted by ranges and written; only the ranges' counts meet in one task."""
    from ..sources.sinks import scratch

    path = scratch(df.sparkSession, "ordered")
    df.orderBy(*_ordering(order)).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumn("_range", F.shiftrightunsigned("_at", 33))
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    return rows.join(before, "_range").select(*df.columns, (F.col("_before") + inside + 1).alias(name))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
