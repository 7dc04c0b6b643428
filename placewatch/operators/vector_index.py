"""Cell index for cosine search: every row lies in the cell of its nearest centre, a query looks into the cells nearest to it."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sinks import note, noted
from .history import top_per_key
from .vector import _best, _first, _matrix, _unit

SAMPLE = 20_000                  # rows the centres are fitted on, those of the least hashes of their ids
MOST_CELLS = 4096                # centres that every task holds
ROUNDS = 12                      # of moving the centres
BLOCK = 2048                     # corpus rows, and queries, that meet as one pair of matrices
TRIED = 256                      # sampled rows whose neighbours tell how many cells a query has to look into
TARGET = 0.97                    # share of those neighbours that must be reached


def fit_centres(corpus: DataFrame, cells: int, c_id: str = "chunk_id", c_vec: str = "embedding", sample: int = SAMPLE,
                k: int = 5) -> tuple[np.ndarray, int]:
    """Centres, and how many of the nearest cells of a row hold ``TARGET`` of its ``k`` nearest others.

    Centres are at most ``cells`` unit vectors: spherical k-means over a sample of at most ``sample`` rows, the same one in every run.

    Rows of the sample with equal vectors count once, so a vector that a third of
    all rows share takes one centre. The neighbours are those within the sample,
    further away than the ones of the whole corpus, so the number errs upwards.
    An empty corpus has no centre.
    """
    if not 0 < cells <= MOST_CELLS:
        raise ValueError(f"between 1 and {MOST_CELLS} cells")
    drawn = (corpus.select(F.col(c_id).alias("_c"), F.col(c_vec).cast("array<double>").alias("_v")).where("size(_v) > 0")
             .orderBy(F.xxhash64("_c"), "_c").limit(sample).select("_v").toPandas())
    rows = _unit(_matrix(drawn["_v"])) if len(drawn) else np.zeros((0, 0))
    rows = np.unique(rows[np.isfinite(rows).all(axis=1)], axis=0)
    if not len(rows):
        return rows, 0
    rng = np.random.default_rng(0)
    centres = rows[rng.choice(len(rows), min(cells, len(rows)), replace=False)]
    for _ in range(ROUNDS):
        nearest = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        held = np.linalg.norm(sums, axis=1) > 0
        centres[held] = _unit(sums[held])
        centres[~held] = rows[rng.choice(len(rows), int((~held).sum()))]
    tried = rng.choice(len(rows), min(TRIED, len(rows)), replace=False)
    scores = rows[tried] @ rows.T
    scores[np.arange(len(tried)), tried] = -np.inf
    nearest = np.argsort(-scores, axis=1)[:, :min(k, len(rows) - 1)]
    place = np.argsort(np.argsort(-(rows[tried] @ centres.T), axis=1), axis=1)
    reached = np.sort(np.take_along_axis(place, (rows @ centres.T).argmax(axis=1)[nearest], axis=1).ravel())
    return centres, int(reached[int(np.ceil(TARGET * len(reached))) - 1]) + 1 if len(reached) else 1


def _near(vectors: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each unit vector."""
    scores = vectors @ centres.T
    n = min(n, centres.shape[0])
    return np.argpartition(-scores, n - 1, axis=1)[:, :n]


def build_index(corpus: DataFrame, path: str, cells: int, c_id: str = "chunk_id", c_vec: str = "embedding",
                sample: int = SAMPLE, spread: int = 8) -> None:
    """Write every row with a direction into blocks of its cell at ``path``, beside the centres.

    Rows without an id, a vector or a length other than zero cannot be found by
    cosine and are left out, as in the exact search. A cell is dealt over
    ``spread`` tasks by its ids, so a vector that many rows share fills blocks
    of several tasks, none of which holds more than a block at a time.
    """
    spark = corpus.sparkSession
    centres, probes = fit_centres(corpus, cells, c_id, c_vec, sample)
    shared = spark.sparkContext.broadcast(centres)
    rows = corpus.select(F.col(c_id).alias("_c"), F.col(c_vec).cast("array<double>").alias("_v")).where("_c IS NOT NULL AND size(_v) > 0")
    kind = rows.schema["_c"].dataType

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            units = _unit(_matrix(part["_v"]))
            good = np.isfinite(units).all(axis=1)
            if len(shared.value) and good.any():
                part = part[good]
                yield pd.DataFrame({"_c": part["_c"], "_v": part["_v"], "cell": _near(units[good], shared.value, 1)[:, 0].astype(np.int32)})

    placed = rows.mapInPandas(assign, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())]))
    dealt = placed.repartition("cell", F.pmod(F.xxhash64("_c"), F.lit(spread))).sortWithinPartitions("cell")
    blocks = dealt.mapInPandas(_blocks(BLOCK), _block_type(kind))
    blocks.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/blocks")
    note(spark, f"{path}/centres", json.dumps({"centres": centres.tolist(), "probes": probes, "id": T.StructType([rows.schema["_c"]]).jsonValue()}))


def _block_type(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)),
                         T.StructField("vectors", T.BinaryType())])


def _blocks(size: int):
    """Packs (_c, _v, cell) rows into blocks of one cell; a task keeps at most one open block per cell of a batch."""
    def block(cell, rows: pd.DataFrame) -> dict:
        return {"cell": cell, "ids": rows["_c"].to_numpy(), "vectors": _matrix(rows["_v"]).tobytes()}

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for part in parts:
            part = part if left is None else pd.concat([left, part], ignore_index=True)
            last, out, left = part["cell"].iloc[-1], [], None
            for cell, rows in part.groupby("cell", sort=False):
                for at in range(0, len(rows), size):
                    some = rows.iloc[at:at + size]
                    if cell == last and len(some) < size:
                        left = some
                    else:
                        out.append(block(cell, some))
            if out:
                yield pd.DataFrame(out)
        if left is not None:
            yield pd.DataFrame([block(left["cell"].iloc[0], left)])

    return pack


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, probes: int | None = None, q_id: str = "query_id",
                 q_vec: str = "embedding", c_id: str = "chunk_id", digits: int = 4) -> DataFrame:
    """The ``k`` nearest rows of every query among those of its ``probes`` nearest cells: (q_id, c_id, rank, score).

    Without ``probes`` it is the number that the index was fitted with.

    Cosines are exact and ties go to the smallest id, as in ``top_k``, which
    remains the exact search; with as many probes as cells the two agree.
    Queries and rows meet as blocks by cell, one pass over the touched cells
    for any number of queries, and a pair of blocks emits its best ``k`` rows per query.
    """
    kept = json.loads(noted(spark, f"{path}/centres"))
    centres, kind = np.array(kept["centres"]), T.StructType.fromJson(kept["id"])["_c"].dataType
    asked = queries.select(F.col(q_id).alias("_c"), F.col(q_vec).cast("array<double>").alias("_v")).where("size(_v) > 0")
    out = T.StructType([T.StructField("_q", asked.schema["_c"].dataType), T.StructField("_c", kind), T.StructField("score", T.DoubleType())])
    probes = probes or kept["probes"]
    if not len(centres):
        found = spark.createDataFrame([], out)
    else:
        shared = spark.sparkContext.broadcast(centres)
        pack = _blocks(BLOCK)

        def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                units = _unit(_matrix(part["_v"]))
                good = np.isfinite(units).all(axis=1)
                if good.any():
                    near = _near(units[good], shared.value, probes)
                    rows = part[good].iloc[np.repeat(np.arange(good.sum()), near.shape[1])]
                    yield from pack([rows.assign(cell=near.ravel().astype(np.int32)).sort_values("cell", kind="stable")])

        def meet(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for r in part.itertuples():
                    vectors = np.frombuffer(r.vectors).reshape(len(r.ids), -1)
                    wanted = _unit(np.frombuffer(r.q_vectors).reshape(len(r.q_ids), -1))
                    best = _best(wanted, np.asarray(r.q_ids), pd.DataFrame({"_c": np.asarray(r.ids), "_v": list(vectors)}), k)
                    if best is not None:
                        yield _first(best, k)

        blocks = spark.read.schema(_block_type(kind)).parquet(f"{path}/blocks")
        wanted = asked.mapInPandas(deal, _block_type(asked.schema["_c"].dataType)).toDF("cell", "q_ids", "q_vectors")
        found = blocks.join(wanted, "cell").mapInPandas(meet, out)
    ranked = top_per_key(found, ["_q"], [F.desc("score"), F.asc("_c")], k, rank="rank")
    return ranked.select(F.col("_q").alias(q_id), F.col("_c").alias(c_id), "rank", F.round("score", digits).alias("score"))


def recall(found: DataFrame, exact: DataFrame, q_id: str = "query_id", c_id: str = "chunk_id") -> DataFrame:
    """One row: exact hits, and the share of them that was found."""
    hit = found.select(q_id, c_id, F.lit(1).alias("_hit"))
    return exact.join(hit, [q_id, c_id], "left").agg(F.count("*").alias("n_hits"), (F.count("_hit") / F.count("*")).alias("recall"))
