"""Exact top-k cosine search over embedded rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sinks import scratch
from .history import top_per_key

BLOCK_ROWS = 4096                # queries that every task holds as one matrix
SCORES = 4_000_000               # scores a task computes at a time
RANK_DIGITS = 10                 # scores equal to this many digits are ties


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.full_like(rows, np.nan), where=norms > 0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _first(found: pd.DataFrame, k: int) -> pd.DataFrame:
    return found.sort_values(["_q", "score", "_c"], ascending=[True, False, True]).groupby("_q").head(k)


def _best(queries: np.ndarray, ids: np.ndarray, rows: pd.DataFrame, k: int) -> pd.DataFrame | None:
    """The k best of ``rows`` for every query (unit vectors); ties go to the smallest id, copies stay bounded."""
    best = None
    step = max(k, SCORES // max(1, len(ids)))
    for at in range(0, len(rows), step):
        some = rows.iloc[at:at + step].sort_values("_c")
        scores = np.round(queries @ _unit(_matrix(some["_v"])).T, RANK_DIGITS)
        scores = np.where(np.isnan(scores), -np.inf, scores)
        if scores.shape[1] > k:
            cut = -np.partition(-scores, k - 1, axis=1)[:, k - 1:k]
            over, tied = scores > cut, scores == cut
            room = k - over.sum(axis=1, keepdims=True)
            keep = over | (tied & (np.cumsum(tied, axis=1) <= room))
        else:
            keep = np.ones_like(scores, dtype=bool)
        q, c = np.nonzero(keep & np.isfinite(scores))
        new = pd.DataFrame({"_q": ids[q], "_c": some["_c"].to_numpy()[c], "score": scores[q, c]})
        best = new if best is None else _first(pd.concat([best, new], ignore_index=True), k)
    return best


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 5, q_id: str = "query_id", q_vec: str = "embedding",
          c_id: str = "chunk_id", c_vec: str = "embedding", digits: int = 4, block: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` nearest corpus rows of every query by cosine: (q_id, c_id, rank, score).

    Ties go to the smallest corpus id. The queries travel to the corpus in
    blocks of about ``block`` rows, one pass over the corpus for each. The hits of
    a block are written and its broadcast is released before the next one is
    read, so what a task or the driver holds is bounded for any number of
    queries; the corpus is never shuffled and a task emits its best ``k`` rows
    per query. ``vector_index`` passes over the corpus once.
    """
    asked = queries.select(F.col(q_id).alias("_q"), F.col(q_vec).cast("array<double>").alias("_v")).where("size(_v) > 0")
    rows = corpus.select(F.col(c_id).alias("_c"), F.col(c_vec).cast("array<double>").alias("_v")).where("size(_v) > 0")
    out = T.StructType([T.StructField("_q", asked.schema["_q"].dataType),
                        T.StructField("_c", rows.schema["_c"].dataType), T.StructField("score", T.DoubleType())])
    found = _hits(asked, rows, k, out, block)
    ranked = top_per_key(found, ["_q"], [F.desc("score"), F.asc("_c")], k, rank="rank")
    return ranked.select(F.col("_q").alias(q_id), F.col("_c").alias(c_id), "rank", F.round("score", digits).alias("score"))


def _hits(asked: DataFrame, rows: DataFrame, k: int, out: T.StructType, block: int) -> DataFrame:
    """The best rows of every task and query; of one block as a plan, of several from a written table."""
    spark = rows.sparkSession
    path = scratch(spark, "queries")
    asked.write.option("maxRecordsPerFile", block).parquet(path)
    stored = spark.read.schema(asked.schema).parquet(path).select("*", F.col("_metadata.file_path").alias("_file"))
    sizes = [(r["_file"], r["count"]) for r in stored.groupBy("_file").count().orderBy("_file").collect()]   # one row per file
    groups, held = [], block
    for file, n in sizes:
        if held + n > block:
            groups.append([])
            held = 0
        groups[-1].append(file)
        held += n
    hits = scratch(spark, "hits")
    for i, files in enumerate(groups):
        part = stored.where(F.col("_file").isin(files)).drop("_file").toPandas()
        shared = spark.sparkContext.broadcast((part["_q"].to_numpy(), _unit(_matrix(part["_v"]))))
        found = _scan(shared, rows, k, out)
        if len(groups) == 1:
            return found
        found.write.parquet(f"{hits}/block={i}")
        shared.destroy()
    return spark.read.schema(out).parquet(hits).select(*out.names) if groups else spark.createDataFrame([], out)


def _scan(shared: Broadcast, rows: DataFrame, k: int, out: T.StructType) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = shared.value
        best = None
        for part in parts:
            new = _best(vectors, ids, part, k)
            if new is not None:
                best = new if best is None else _first(pd.concat([best, new], ignore_index=True), k)
        if best is not None:
            yield best

    return rows.mapInPandas(run, out)


def search_result(hits: DataFrame, questions: DataFrame, q_id: str, question: str, k: int = 5) -> DataFrame:
    """One struct row per question: count, ordered hits with text, file, page, score, and an error field.

    ``hits`` holds at most ``k`` rows per question with rank, text, source_uri,
    page_number and score.
    """
    from ..functions.scalars import file_name

    hit = F.struct(F.col("chunk_to_retrieve").alias("text"), file_name("source_uri").alias("source_pdf"),
                   F.col("page_number").cast("int").alias("page_number"), F.col("score").alias("similarity_score"))
    packed = (hits.where(F.col("rank") <= k).groupBy(q_id)
              .agg(F.array_sort(F.collect_list(F.struct("rank", hit.alias("h")))).alias("_h"))
              .select(q_id, F.transform("_h", lambda x: x["h"]).alias("_hits")))
    kind = packed.schema["_hits"].dataType.simpleString()
    out = questions.select(q_id, question).join(packed, q_id, "left")
    empty = F.from_json(F.lit("[]"), kind)
    return out.select(q_id, F.struct(
        F.col(question).alias("question"), F.coalesce(F.size("_hits"), F.lit(0)).alias("chunks_count"),
        F.coalesce("_hits", empty).alias("chunks"), F.lit(None).cast("string").alias("error")).alias("result"))
