"""Overlapping text chunks with running positions, and chunk embeddings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import let

PAGE_BITS = 10   # 1024 pages to a block
BLANKS = r"(?U)[\s\x1c-\x1f]+"


def chunk(df: DataFrame, source: str, page: str, text: str, size: int = 1200, overlap: int = 200,
          min_chars: int = 100) -> DataFrame:
    """Fixed-size overlapping pieces of each page, numbered through each source.

    Blanks collapse to one space; pieces of fewer than ``min_chars`` characters
    after trimming are left out and take no number. ``page`` is a number. Pieces
    are numbered in blocks of pages, so a huge source is split over tasks, and
    block totals give each block its first number.
    """
    step = size - overlap

    def cut(flat: Column) -> Column:
        starts = F.when(F.length(flat) > 0, F.sequence(F.lit(0), F.length(flat) - 1, F.lit(step)))
        return F.filter(F.transform(starts, lambda s: F.trim(F.substring(flat, s + 1, F.lit(size)))),
                        lambda p: F.length(p) >= min_chars)

    pieces = let(F.trim(F.regexp_replace(F.col(text), BLANKS, " ")), cut)
    block = F.shiftright(page, PAGE_BITS)
    rows = (df.where(F.col(source).isNotNull() & F.col(page).isNotNull() & block.isNotNull())
            .select(source, page, F.posexplode(pieces).alias("_i", "chunk_to_retrieve"))
            .withColumn("_block", block).repartition(source, "_block"))
    inside = Window.partitionBy(source, "_block").orderBy(page, "_i")
    before = Window.partitionBy(source).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # Counting over all columns, and the null tests above that the join would add on one side only,
    # keep both uses of the shuffled rows alike: they are cut and shuffled once.
    first = (rows.groupBy(source, "_block").agg(F.expr(f"count(chunk_to_retrieve, `{page}`, _i)").alias("_n"))
             .withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    out = rows.withColumn("_rn", F.row_number().over(inside)).join(first, [source, "_block"])
    position = F.col("_first") + F.col("_rn") - 1
    return out.select(
        F.concat(F.col(source), F.lit("::p"), F.col(page).cast("string"), F.lit("::c"),
                 position.cast("string")).alias("chunk_id"),
        position.cast("long").alias("chunk_position"), "chunk_to_retrieve",
        F.col(source).alias("source_uri"), F.col(page).alias("page_number"))


def chunks_from_parsed(df: DataFrame, path: str, parsed: str) -> DataFrame:
    """Chunks out of nested parsed documents (VARIANT); documents with an error are left out."""
    ok = df.where(F.try_variant_get(parsed, "$.error_status", "string").isNull())
    rows = ok.lateralJoin(
        ok.sparkSession.tvf.variant_explode_outer(F.variant_get(F.col(parsed).outer(), "$.document.contents", "variant")))
    got = {"chunk_id": "string", "chunk_position": "int", "chunk_to_retrieve": "string", "chunk_to_embed": "string"}
    return rows.where(F.col("value").isNotNull()).select(
        *[F.variant_get("value", f"$.{n}", t).alias(n) for n, t in got.items()],
        F.coalesce(F.variant_get(parsed, "$.document.source_uri", "string"), F.col(path)).alias("source_uri"),
        F.try_variant_get("value", "$.pages[0].page_id", "int").alias("page_number"))


def hashed_words(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Deterministic encoder: counts of lower-case words, bucket = first four hex digits of MD5 modulo ``dims``."""
    word = re.compile(r"[^\W_]+")
    seen: dict[str, int] = {}

    def bucket(w: str) -> int:
        if w not in seen:
            if len(seen) > 200_000:
                seen.clear()
            seen[w] = int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % dims
        return seen[w]

    def encode(texts: list[str]) -> np.ndarray:
        return np.stack([np.bincount([bucket(w) for w in word.findall((t or "").lower())] or [0], minlength=dims)
                         * (1.0 if word.search(t or "") else 0.0) for t in texts]).astype(np.float32)

    return encode


def embed(df: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray], batch: int = 25,
          name: str = "embedding") -> DataFrame:
    """Add an embedding column, calling ``encoder`` on at most ``batch`` texts at a time; only the texts pass through Python."""
    return df.withColumn(name, _encoded(encoder, batch, nulls=True)(F.col(text)))


def _encoded(encoder: Callable[[list[str]], np.ndarray], batch: int, nulls: bool) -> Callable[[Column], Column]:
    """Vectors of texts, ``batch`` texts at a time from the Arrow rows on, so a worker holds one batch; without ``nulls`` a NULL text has none."""
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            for i in range(0, len(part), batch):
                texts = part.slice(i, batch).to_pylist()
                given = texts if nulls else [t for t in texts if t is not None]
                vectors = iter([np.asarray(v, dtype=np.float32) for v in encoder(given)] if given else [])
                yield pa.array([next(vectors) if nulls or t is not None else None for t in texts], pa.list_(pa.float32()))

    return run


def hashed_counts(df: DataFrame, text: str, dims: int = 64, name: str = "embedding") -> DataFrame:
    """The ``hashed_words`` embedding as a native expression."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), 0)
    buckets = F.transform(words, lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("int") % dims))
    sizes = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)),
                        lambda b: F.size(F.filter(F.col("_buckets"), lambda x: x == b)).cast("float"))
    return df.withColumn("_buckets", buckets).withColumn(name, sizes).drop("_buckets")


def refresh_embeddings(chunks: DataFrame, embedded: DataFrame, encoder: Callable[[list[str]], np.ndarray], key: str = "chunk_id",
                       text: str = "chunk_to_retrieve", batch: int = 25) -> DataFrame:
    """Every chunk with its embedding, the digest of its text, and ``fresh``: only new and changed texts pass through the encoder.

    ``embedded`` is an earlier result (key, text_digest, embedding). A chunk that
    is gone has no row; a NULL text has a NULL embedding and is never fresh.
    """
    old = embedded.select(key, F.col("text_digest").alias("_digest"), F.col("embedding").alias("_old"))
    now = chunks.withColumn("text_digest", F.sha2(F.col(text).cast("binary"), 256))
    both = now.join(old, key, "left").withColumn("fresh", F.col(text).isNotNull() & ~F.equal_null("_digest", "text_digest"))

    made = both.withColumn("_new", _encoded(encoder, batch, nulls=False)(F.when(F.col("fresh"), F.col(text))))
    vector = F.when(F.col("fresh"), F.col("_new")).when(F.col(text).isNotNull(), F.col("_old"))
    return made.select(*chunks.columns, vector.alias("embedding"), "text_digest", "fresh")
