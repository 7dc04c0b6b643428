"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Source partition p sends A[p][s] rows to shard s. The matrix is drawn from the
multivariate hypergeometric law with the partitions' row counts and the shards'
sizes as margins, so it has the law that a uniform permutation of all rows
would give. Each partition permutes its rows, hands out its counts, and each
shard permutes what it has received.

No task or driver holds the matrix: a task walks a seeded tree over the
partitions' ranges and draws only the way to its own row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: monotonically_increasing_id() has the partition above this bit and the row's place in it below.
PLACE_BITS = 33


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn without return are good. Any size: inversion over a window around the mode."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
    spread = (n * (good / (good + bad)) * (bad / (good + bad))) ** 0.5
    k = np.arange(max(low, mode - int(12 * spread) - 40), min(high, mode + int(12 * spread) + 40) + 1, dtype=np.float64)
    step = np.log((good - k[:-1]) * (n - k[:-1])) - np.log((k[:-1] + 1) * (bad - n + k[:-1] + 1))
    log_p = np.concatenate([[0.0], np.cumsum(step)])
    p = np.cumsum(np.exp(log_p - log_p.max()))
    return int(k[min(np.searchsorted(p, rng.random() * p[-1], side="right"), len(k) - 1)])


def share(rng: np.random.Generator, sizes: list[int], n: int) -> list[int]:
    """``n`` rows drawn without return from shards with ``sizes`` open places: how many fall to each."""
    out, rest = [], sum(sizes)
    for size in sizes:
        rest -= size
        out.append(hypergeometric(rng, size, rest, n))
        n -= out[-1]
    return out


def matrix_row(p: int, before: np.ndarray, sizes: list[int], seed: int) -> list[int]:
    """Row ``p`` of the matrix; ``before``: rows before each partition, the total last."""
    lo, hi, open_places = 0, len(before) - 1, list(sizes)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = share(np.random.default_rng([seed, lo, hi]), open_places, int(before[mid] - before[lo]))
        if p < mid:
            open_places, hi = left, mid
        else:
            open_places, lo = [a - b for a, b in zip(open_places, left, strict=True)], mid
    return open_places


def shuffle_to_shards(table: DataFrame, shards: int = 8, seed: int = 20, rows_per_file: int = 20_000, stage: bool = False) -> DataFrame:
    """Every row of ``table`` once, in a uniformly random order over ``shards`` shards whose row counts differ by one at most.

    Returns ``row`` (a struct of all columns, whatever their names), ``shard``
    and ``slot`` (gapless from 0 in each shard), read back from files in slot
    order. Law: ``rows``. Nulls, empty texts and repeated rows are rows like
    any other; an empty table gives no row. The order of rows within a
    partition must be the same each time it is read, so ``table`` has to be a
    stored table; give ``stage=True`` for anything else and it is stored first.
    A shard is written in files of about ``rows_per_file`` rows, one task each.
    """
    if stage:
        table = stored(table, "shard-input")
    spark = table.sparkSession
    counts = dict(table.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect())  # a number per partition
    before = np.concatenate([[0], np.cumsum([counts.get(p, 0) for p in range(max(counts, default=0) + 1)])]).astype(np.int64)
    total = int(before[-1])
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    files = max(1, -(-max(sizes) // rows_per_file))

    @F.pandas_udf("int")
    def shard_of(places: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held, labels = -1, np.empty(0, np.int32)
        for s in places:
            at = s.to_numpy()
            out = np.empty(len(at), np.int32)
            for p in np.unique(at >> PLACE_BITS):
                if p != held:
                    held, labels = p, np.repeat(np.arange(shards, dtype=np.int32), matrix_row(int(p), before, sizes, seed))
                    np.random.default_rng([seed, int(p)]).shuffle(labels)
                own = at >> PLACE_BITS == p
                out[own] = labels[at[own] & (2**PLACE_BITS - 1)]
            yield pd.Series(out)

    def dealt(df: DataFrame) -> DataFrame:
        order = F.xxhash64(F.lit(seed), F.col("place"))
        return (df.withColumn("place", F.monotonically_increasing_id()).withColumn("shard", shard_of("place"))
                .withColumn("order", order).withColumn("file", F.pmod(F.shiftrightunsigned("order", 7), F.lit(files)).cast("int")))

    # A place is random in its shard: first the file, then the order inside the file.
    sums = dealt(table.select()).groupBy("shard", "file").agg(F.count("*").alias("n"))
    starts = sums.selectExpr("shard", "file", "sum(n) OVER (PARTITION BY shard ORDER BY file) - n AS start")
    rows = dealt(table.select(F.struct("*").alias("row"))).repartition("shard", "file")
    placed = (rows.join(starts, ["shard", "file"])
              .selectExpr("row", "shard", "start + row_number() OVER (PARTITION BY shard, file ORDER BY order, place) - 1 AS slot"))
    out = stored(placed, "shards", ("shard",))
    if total != (n := out.count()):
        raise RuntimeError(f"{n} of {total} rows were written; the table gave its rows in another order on a second read, use stage=True")
    return out
