"""Line dedup: content-defined chunks of lines; chunks that occur elsewhere are removed after comparing their bytes.

A rolling hash over the hashes of two neighbouring lines proposes a boundary
after the second; a proposal right after another one is passed over. So a
boundary depends on three lines only, chunks inside a document have two lines
at least, and inserted lines shift no boundary further away.

Chunks miss what lies between the ends of a repeated passage and the next
boundaries inside. ``repeated_passages`` looks at each two neighbouring lines
with words instead, so repeats of two such lines or more are found whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_shuffle, stored

#: A line's hash: the first 32 bits of its MD5. Rolling hash of two lines: before * ROLL + last. One in ODDS proposes a boundary.
ROLL, ODDS = 31, 2
#: Bits of the map of hashes met twice (8 MB); a power of two. Where it fills up, it only spares fewer rows the shuffle.
MAP_BITS = 1 << 26


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def line_chunks(documents: DataFrame, with_text: bool) -> DataFrame:
    """Chunks of two lines or more with words: ``key`` (doc_id, hash of the text, number of the first line), ``lines``, ``digest`` and, if wanted, ``chunk``."""
    lines = documents.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h"), F.split("text", "\n").alias("lines"))
    hashed = lines.withColumn("hashes", F.transform("lines", _line_hash))

    def proposed(i: Column) -> Column:
        return (i > 0) & ((F.get("hashes", i - 1) * ROLL + F.get("hashes", i)) % ODDS == 0)

    ends = F.filter(F.sequence(F.lit(0), F.size("lines") - 1),
                    lambda i: (i == F.size("lines") - 1) | (proposed(i) & ~proposed(i - 1)))
    # Outer, as the optimizer would otherwise push a filter on the array below the hashes, and make them anew for each element.
    cut = (hashed.select("doc_id", "h", "lines", ends.alias("ends"))
           .select("doc_id", "h", "lines", "ends", F.posexplode_outer("ends").alias("k", "end")))
    first = F.when(F.col("k") == 0, 0).otherwise(F.get("ends", F.col("k") - 1) + 1)
    part = cut.select("doc_id", "h", first.alias("first"), (F.col("end") - first + 1).alias("lines"),
                      F.slice("lines", first + 1, F.col("end") - first + 1).alias("part"))
    part = part.where((F.col("lines") > 1) & (F.size(F.filter("part", lambda x: F.trim(x) != "")) > 1))
    chunk = F.array_join("part", "\n")
    return part.select(F.struct("doc_id", "h", "first").alias("key"), "lines", F.md5(chunk).alias("digest"),
                       *([chunk.alias("chunk")] if with_text else []))


def repeated_chunks(documents: DataFrame) -> DataFrame:
    """``key`` and ``lines`` of each chunk whose bytes are met earlier, by doc_id (nulls first), hash of the text and line.

    Chunks are grouped by digest and bytes, so equality is never by digest
    alone; copies combine before the shuffle. A digest that stands for
    different bytes removes nothing.
    """
    same = line_chunks(documents, True).groupBy("digest", "chunk").agg(F.min("key").alias("a"), F.max("key").alias("b"))
    known = (same.groupBy("digest").agg(F.min("a").alias("kept"), F.max("b").alias("last"), F.count("*").alias("n"))
             .where("n = 1 AND kept != last").select("digest", "kept"))
    return line_chunks(documents, False).join(known, "digest").where("key != kept").select("key", "lines").distinct()


def line_pairs(documents: DataFrame, with_text: bool) -> DataFrame:
    """Each line with words and the next one, with the blank lines between: ``key``, ``k`` (number in the text), ``lines``, ``x`` (hash), ``digest`` and, if wanted, ``chunk``."""
    lines = documents.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h"), F.split("text", "\n").alias("lines"))
    at = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.trim(F.get("lines", i)) != "")
    worded = lines.select("doc_id", "h", "lines", at.alias("at"))

    def pair(k: Column) -> Column:
        first, count = F.get("at", k), F.get("at", k + 1) - F.get("at", k) + 1
        return F.struct(k.alias("k"), first.alias("first"), count.alias("lines"), F.array_join(F.slice("lines", first + 1, count), "\n").alias("chunk"))

    pairs = F.when(F.size("at") > 1, F.transform(F.sequence(F.lit(0), F.size("at") - 2), pair))
    # Outer for the same reason as above.
    each = worded.select("doc_id", "h", F.explode_outer(pairs).alias("p")).where("p IS NOT NULL")
    return each.select(F.struct("doc_id", "h", "p.first").alias("key"), "p.k", "p.lines", F.xxhash64("p.chunk").alias("x"), F.md5("p.chunk").alias("digest"),
                       *([F.col("p.chunk").alias("chunk")] if with_text else []))


def _likely(rows: DataFrame, some: DataFrame) -> DataFrame:
    """Rows whose ``x`` may be among ``some``, by a bit map of fixed size; none that is there gets lost."""
    def place(x: str) -> Column:
        return F.pmod(F.col(x), F.lit(MAP_BITS)) + 1

    maps = some.groupBy(F.bitmap_bucket_number(place("x")).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place("x"))).alias("_map"))
    at = F.bitmap_bit_position(place("x"))
    byte = F.conv(F.hex(F.substring("_map", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    # At most MAP_BITS / 32768 rows of 4 KB: the size of what is broadcast is known.
    met = rows.withColumn("_bucket", F.bitmap_bucket_number(place("x"))).join(F.broadcast(maps), "_bucket")
    return met.where(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1).drop("_bucket", "_map")


def repeated_passages(documents: DataFrame) -> DataFrame:
    """``key`` and ``lines`` of the lines that go: pairs of neighbouring lines whose bytes are met earlier, in the order of ``repeated_chunks``.

    The first occurrence of each repeated pair stays whole: a line that such a
    pair shares with a pair that goes stays too. Equality is by bytes; only the
    bytes of pairs whose hash is met twice are shuffled, those of all others
    stay where they are read.
    """
    twice = stored(line_pairs(documents, False).groupBy("x").agg(F.count("*").alias("n")).where("n > 1").select("x"), "line-pairs")
    # Not a semi join: that would be pushed below the map, and all pairs shuffled with their bytes.
    same = _likely(line_pairs(documents, True), twice).join(by_shuffle(twice), "x")
    same = same.groupBy("x", "digest", "chunk").agg(F.min("key").alias("kept"), F.max("key").alias("last"))
    known = same.groupBy("x", "digest").agg(F.min("kept").alias("kept"), F.max("last").alias("last"), F.count("*").alias("n"))
    known = stored(known.where("n = 1 AND kept != last").select("x", "digest", "kept"), "first-pairs")
    met = _likely(line_pairs(documents, False), known).join(by_shuffle(known), ["x", "digest"]).select("key", "k", "lines", (F.col("key") == F.col("kept")).alias("first"))
    # Rows equal in doc_id and text are one document.
    met = met.distinct()
    w = Window.partitionBy("key.doc_id", "key.h").orderBy("k")
    before = F.coalesce(F.lag("first").over(w) & (F.lag("k").over(w) == F.col("k") - 1), F.lit(False)).cast("int")
    after = F.coalesce(F.lead("first").over(w) & (F.lead("k").over(w) == F.col("k") + 1), F.lit(False)).cast("int")
    rest = met.withColumn("_before", before).withColumn("_after", after).where("NOT first AND lines > _before + _after")
    key = F.struct("key.doc_id", "key.h", (F.col("key.first") + F.col("_before")).alias("first"))
    return rest.select(key.alias("key"), (F.col("lines") - F.col("_before") - F.col("_after")).alias("lines"))


def dedup_lines(documents: DataFrame, text_length: str | None = None, counted: bool = False, passages: bool = False) -> DataFrame:
    """``documents`` without repeated multi-line chunks, the first occurrence stays; one row for each row, other columns as they are.

    With ``passages``, repeats of two lines with words or more go as a whole
    (see ``repeated_passages``), wherever chunks end; blank lines around them stay.

    ``counted`` adds ``_lines`` and ``_removed_lines``. The column named
    ``text_length``, if given, gets the new length of the text. A null text stays null with 0
    lines; an empty text has one line; a text all of whose lines go becomes
    empty. Rows equal in doc_id and text are one document and are treated
    alike; a null doc_id comes first in order. Lines of blanks count as lines
    of a chunk, but two lines with words are needed. Line ends are ``\\n``.
    """
    found = repeated_passages(documents) if passages else repeated_chunks(documents)
    gone = (found.groupBy(F.col("key.doc_id").alias("_doc"), F.col("key.h").alias("_hash"))
            .agg(F.sort_array(F.collect_list(F.struct(F.col("key.first").alias("first"), "lines"))).alias("_gone")))
    rows = documents.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_h"))
    met = rows.join(gone, rows["_id"].eqNullSafe(gone["_doc"]) & (rows["_h"] == gone["_hash"]), "left")
    met = met.select("_row", F.split("_row.text", "\n").alias("_all"), "_gone")

    def after(k: Column) -> Column:
        return F.when(k < 0, 0).otherwise(F.get("_gone", k)["first"] + F.get("_gone", k)["lines"])

    # What stays lies between two chunks that go: before the k-th, and behind the last. Passages overlap, in order of both ends.
    until = F.concat(F.transform("_gone", lambda g: g["first"]), F.array(F.size("_all")))
    stays = F.flatten(F.transform(until, lambda stop, k: F.slice("_all", after(k - 1) + 1, F.greatest(stop - after(k - 1), F.lit(0)))))
    text = F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(F.array_join(stays, "\n"))
    count = F.size("_all") - F.size(stays)
    out = met.select("_row", text.alias("_text"), F.when(F.col("_all").isNull(), 0).otherwise(F.size("_all")).alias("_lines"),
                     F.when(F.col("_gone").isNull(), 0).otherwise(count).alias("_removed_lines"))
    new = {"text": F.col("_text"), **({text_length: F.length("_text").cast(documents.schema[text_length].dataType)} if text_length else {})}
    return out.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in documents.columns], *(["_lines", "_removed_lines"] if counted else []))
