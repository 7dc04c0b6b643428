"""Substring dedup by content-defined chunking with a gear rolling hash.

A chunk ends where the rolling hash of the last 16 bytes has its top bits
clear, so boundaries follow the content and an insertion shifts only the
chunks around it. Chunks are compared by a 128-bit digest; runs of chunks met
before, of enough words, are the repeated passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Least bytes of a chunk, the most, and one boundary in so many bytes on average (a power of two).
LEAST, MOST, EVERY = 8, 512, 32
#: ``at`` of a chunk holds its first byte, its bytes and the words that start in it, so that rows stay short: in SQL.
START, BYTES, WORDS = "shiftright(at, 20)", "(shiftright(at, 10) & 1023)", "(at & 1023)"
#: The random 16-bit number of each byte value, from a seed.
GEAR = np.random.default_rng(2024).integers(0, 2**16, 256, dtype=np.uint16)


def boundaries(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of some UTF-8 bytes; the last one is their number.

    The hash doubles at each byte and adds the byte's number, so 16 bits forget
    all but 16 bytes; it is built by doubling the window. A boundary within
    ``LEAST`` bytes of another proposal is passed over, a chunk over ``MOST``
    bytes is cut from its start, and no character is cut.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    h = GEAR[data]
    for w in (1, 2, 4, 8):
        h[w:] = h[w:] + (h[:-w] << np.uint16(w))
    at = np.flatnonzero(h < 2**16 // EVERY) + 1
    at = at[np.diff(at, prepend=-LEAST) >= LEAST]
    ends = np.append(at[at < n], n)
    long = np.flatnonzero(np.diff(ends, prepend=0) > MOST)
    if len(long):
        starts = np.append(0, ends[:-1])
        ends = np.sort(np.concatenate([ends, *[np.arange(starts[i] + MOST, ends[i], MOST) for i in long]]))
    # On to the next character's first byte.
    for _ in range(3):
        inside = (ends < n) & ((data[np.minimum(ends, n - 1)] & 0xC0) == 0x80)
        ends = ends + inside
    return np.unique(ends)


def text_chunks(documents: DataFrame) -> DataFrame:
    """Chunks of whole texts: doc_id, hash of the text, ``at`` (where it lies, see ``START``) and the digest (two longs)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").where("text != ''")

    def cut(batches) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(batch.num_rows):
                raw = batch.column(2)[i].as_py().encode("utf-8", "replace")
                data = np.frombuffer(raw, np.uint8)
                ends = boundaries(data)
                starts = np.append(0, ends[:-1])
                space = (data == 32) | ((data >= 9) & (data <= 13))
                begins = ~space & np.append(True, space[:-1])
                words = np.add.reduceat(begins, starts, dtype=np.int64)
                digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), "<i8").reshape(-1, 2)
                n, at = len(ends), starts.astype(np.int64) << 20 | (ends - starts) << 10 | words
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[i]] * n, pa.int64()), pa.array([hashes[i]] * n, pa.int64()), pa.array(at),
                    pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy())], ["doc_id", "h", "at", "d1", "d2"])

    return rows.mapInArrow(cut, "doc_id long, h long, at long, d1 long, d2 long")


def repeated_passages(documents: DataFrame, least_words: int = 16) -> DataFrame:
    """Passages to remove: ``doc_id``, ``h`` (hash of the text), ``start`` and ``bytes`` in its UTF-8, ``words``, ``first_doc_id``.

    A passage is a run of neighbouring chunks that are all met earlier, by
    doc_id (nulls first), hash of the text and place, and in which at least
    ``least_words`` words start; the first occurrence of a chunk stays.
    ``first_doc_id`` has the first occurrence of the run's first chunk. Rows
    equal in doc_id and text are one document. Null and empty texts have no
    chunk. Text before the first boundary inside a passage, and behind the
    last, is not part of it: 32 bytes on average at each end.
    """
    chunks = text_chunks(documents)
    # Half a digest tells most chunks that are met once; both halves decide. What is small is written, so that joins can split hot digests.
    twice = stored(chunks.groupBy("d1").agg(F.count("*").alias("n")).where("n > 1").select("d1"), "digests")
    some = stored(chunks.join(twice, "d1", "left_semi"), "chunks")
    key = F.struct("doc_id", "h", "at")
    known = stored(some.groupBy("d1", "d2").agg(F.min(key).alias("kept"), F.max(key).alias("last")).where("kept != last").select("d1", "d2", "kept"), "first-chunks")
    met = some.join(known, ["d1", "d2"]).where(key != F.col("kept")).select("doc_id", "h", "at", "kept").distinct()
    met = met.selectExpr("doc_id", "h", "kept", "at", f"{START} AS start", f"{BYTES} AS bytes", f"{WORDS} AS words")
    in_text = Window.partitionBy("doc_id", "h").orderBy("at")
    begins = F.when(F.lag(F.col("start") + F.col("bytes")).over(in_text) == F.col("start"), 0).otherwise(1)
    runs = (met.withColumn("begins", begins).withColumn("run", F.sum("begins").over(in_text)).groupBy("doc_id", "h", "run")
            .agg(F.min("start").alias("start"), F.sum("bytes").alias("bytes"), F.sum("words").alias("words"), F.min_by("kept", "at").alias("kept")))
    return runs.where(F.col("words") >= least_words).select("doc_id", "h", "start", "bytes", "words", F.col("kept.doc_id").alias("first_doc_id"))


def dedup_substrings(documents: DataFrame, least_words: int = 16, counted: bool = False) -> DataFrame:
    """``documents`` without their repeated passages, one row for each row, other columns as they are; a null text stays null.

    ``counted`` adds ``_removed_bytes`` and ``_removed_words``.
    """
    passages = repeated_passages(documents, least_words)
    gone = passages.groupBy(F.col("doc_id").alias("_doc"), F.col("h").alias("_hash")).agg(F.sort_array(F.collect_list(F.struct("start", "bytes", "words"))).alias("_gone"))
    rows = documents.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_h"))
    met = rows.join(gone, rows["_id"].eqNullSafe(gone["_doc"]) & (rows["_h"] == gone["_hash"]), "left")
    raw = F.col("_row.text").cast("binary")
    until = F.concat(F.transform("_gone", lambda g: g["start"]), F.array(F.octet_length(raw).cast("long")))

    def after(k):
        return F.when(k < 0, 0).otherwise(F.get("_gone", k)["start"] + F.get("_gone", k)["bytes"])

    parts = F.transform(until, lambda stop, k: F.substring(raw, (after(k - 1) + 1).cast("int"), (stop - after(k - 1)).cast("int")).cast("string"))
    text = F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(F.array_join(parts, ""))

    def total(name):
        return F.coalesce(F.aggregate("_gone", F.lit(0).cast("long"), lambda n, g: n + g[name]), F.lit(0).cast("long")).alias(f"_removed_{name}")

    out = met.select("_row", text.alias("_text"), total("bytes"), total("words"))
    return out.select(*[(F.col("_text") if c == "text" else F.col("_row")[c]).alias(c) for c in documents.columns],
                      *(["_removed_bytes", "_removed_words"] if counted else []))
