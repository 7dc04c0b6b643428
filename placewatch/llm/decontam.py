"""Benchmark decontamination: SimHash of item-sized windows, multi-index blocks, exact similarity.

Only DataFrame functions are used. Windows are laid where a document shares
enough word shingles with an item of the window's size to reach the similarity
at all; their fingerprints look up the items' fingerprints by blocks (of which
one more than the radius: some block is equal), complete distances are checked,
and the similarity of the shingle multisets decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, by_shuffle, stored

#: Four counters of 16 bits in a long: bits i, i + 16, i + 32 and i + 48 of the hashes are counted at once.
LANES = 0x0001000100010001
#: Shingles of one window that the counters can count.
LONGEST = 2**16 - 1


def shingle_hashes(text: Column, words: int) -> tuple[Column, Column]:
    """The words of a text, and an expression on a column ``_words`` that hashes each run of ``words`` words; fewer words are one run, none give none."""
    split = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES), lambda w: w != "")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_words") - words, F.lit(0))),
                       lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(words)]))
    return split, F.when(F.size("_words") > 0, runs).otherwise(F.array().cast("array<long>"))


def hashed(df: DataFrame, words: int, *carried: str | Column) -> DataFrame:
    """The carried columns and ``_h``, the shingle hashes of ``text`` in order."""
    split, runs = shingle_hashes(F.col("text"), words)
    return df.select(*carried, split.alias("_words")).select("*", runs.alias("_h")).drop("_words")


def with_fingerprint(df: DataFrame, hashes: str, name: str) -> DataFrame:
    """Adds ``name``: bit i is 1 if it is set in over half the hashes of the array ``hashes``."""
    lanes = [f"aggregate({hashes}, 0L, (n, x) -> n + (shiftrightunsigned(x, {i}) & {LANES}L))" for i in range(16)]
    bits = [f"IF((shiftrightunsigned(_lanes[{i % 16}], {i - i % 16}) & {LONGEST}L) * 2 > size({hashes}), shiftleft(1L, {i}), 0L)" for i in range(64)]
    counted = df.withColumn("_lanes", F.expr(f"array({', '.join(lanes)})"))
    return counted.withColumn(name, F.expr(" | ".join(bits))).drop("_lanes")


def _blocks(fp: str, size: str, radius: int) -> str:
    """A key for each of ``radius + 1`` blocks of a fingerprint: equal keys mean an equal block in windows of one size."""
    bounds = [64 * j // (radius + 1) for j in range(radius + 2)]
    keys = [f"struct({size} AS size, {j} AS block, shiftrightunsigned({fp}, {low}) & {(1 << (high - low)) - 1}L AS bits)"
            for j, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False))]
    return f"array({', '.join(keys)})"


def _shared(a: Column, b: Column) -> Column:
    """Size of the intersection of two multisets."""
    def times(x: Column, xs: Column) -> Column:
        return F.size(F.filter(xs, lambda y: y == x))

    each_once = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    counted = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(times(x, a), times(x, b)))
    return F.when(each_once, F.size(F.array_intersect(a, b))).otherwise(counted)


def contaminated(documents: DataFrame, benchmark: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 20,
                 broadcast_rows: int = 200_000) -> DataFrame:
    """``doc_id``, ``item_id``, ``start_word``, ``n_runs`` (shingles) and ``similarity`` of the most similar window (the first of several) for each pair that has one.

    A window has as many words as the item, or is the whole document if that
    is shorter. Similarity: shared shingles over all, as multisets of runs of
    ``words`` lower-cased words (a text of fewer words is one run), at least
    ``similarity``. ``radius``: differing bits of the fingerprints; at 0.8 the
    expected distance is 10 bits, so 20 loses about one window in ten thousand
    at the very limit and fewer above it. Items over 65,535 runs are an error.
    Null and empty texts match nothing, also each other; rows with equal doc_id
    give one row per item, equal items one row each, a null id is an id. Other
    columns are ignored, empty tables give no row. Item shingles are broadcast
    in blocks of ``broadcast_rows`` at most, each met by all documents.
    """
    items = hashed(benchmark, words, "item_id").where(F.size("_h") > 0).withColumn("m", F.size("_h"))
    items = stored(with_fingerprint(items, "_h", "fp"), "items")
    number, rows, longest = items.agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.max("m"), F.lit(0))).first()
    if longest > LONGEST:
        raise ValueError(f"an item has {longest} shingles, more than {LONGEST}")
    blocks = max(1, -(-2 * rows // broadcast_rows))
    # An item by its runs and size: equal items are looked for once.
    runs = items.select(F.explode(F.array_distinct("_h")).alias("x"), F.xxhash64("_h").alias("text_key"), "m").distinct()
    runs = stored(runs.withColumn("block", F.pmod("x", F.lit(blocks))), "runs")
    sizes = dict(runs.groupBy("block").count().collect())  # one number per block

    key = F.xxhash64("text").alias("h")
    shingles = hashed(documents, words, "doc_id", key)
    # Outer, as the optimizer would otherwise push a filter on the array below the words, and hash them anew for each element.
    each = shingles.select("doc_id", "h", F.size("_h").alias("d"), F.posexplode_outer("_h").alias("p", "x"))
    hits = None
    for b, n in sorted(sizes.items()):
        part = runs.where(F.col("block") == b).select("x", "text_key", "m")
        met = each.join(F.broadcast(part) if n <= broadcast_rows else part, "x").select("doc_id", "h", "d", "p", "text_key", "m")
        hits = met if hits is None else hits.unionByName(met)
    if hits is None:
        hits = each.join(runs, "x").select("doc_id", "h", "d", "p", "text_key", "m")

    # Windows whose shared runs can reach the similarity: the hit that makes their number enough lies inside.
    width = F.least("m", "d")
    enough = F.ceil(F.lit(similarity) * (width + F.col("m")) / F.lit(1 + similarity) - 1e-9).cast("int")
    at = hits.groupBy("doc_id", "h", "d", "text_key", "m").agg(F.sort_array(F.collect_set("p")).alias("ps")).where(F.size("ps") >= enough)
    begins = F.filter("ps", lambda p, k: F.get("ps", k + enough - 1) - p < F.col("m"))
    windows = at.select("doc_id", "h", width.alias("width"), F.col("m").alias("size"),
                        F.explode(F.array_distinct(F.transform(begins, lambda p: F.least(p, F.col("d") - width)))).alias("start")).distinct()
    grouped = windows.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "width", "size")).alias("windows"))
    texts = documents.select("doc_id", "text", key)
    found = texts.join(grouped, texts["doc_id"].eqNullSafe(grouped["doc_id"]) & (texts["h"] == grouped["h"])).select(texts["doc_id"], "text", "windows")
    cut = hashed(found, words, "doc_id", "windows").select("doc_id", "_h", F.explode("windows").alias("w"))
    cut = cut.select("doc_id", "w.start", "w.size", F.slice("_h", F.col("w.start") + 1, F.col("w.width")).alias("runs"))
    prints = stored(with_fingerprint(cut, "runs", "window_fp"), "windows")

    of_window, of_item = _blocks("window_fp", "size", radius), _blocks("fp", "m", radius)
    keyed = prints.select("*", F.expr(of_window).alias("blocks")).select("*", F.explode("blocks").alias("key"))
    table = items.select("item_id", "fp", F.col("_h").alias("item_runs"), F.expr(of_item).alias("item_blocks")).select("*", F.explode("item_blocks").alias("key"))
    near = keyed.join(by_shuffle(table, number * (radius + 1)), "key").where(F.bit_count(F.col("window_fp").bitwiseXOR(F.col("fp"))) <= radius)
    # The same pair comes once for each equal block: only the first of them counts.
    near = near.where("key.block = array_position(zip_with(blocks, item_blocks, (a, b) -> a.bits = b.bits), true) - 1")
    shared = _shared(F.col("runs"), F.col("item_runs"))
    score = near.select("doc_id", "item_id", "start", F.size("runs").alias("n"), shared.alias("c"), F.size("item_runs").alias("m"))
    score = score.withColumn("similarity", F.col("c") / (F.col("n") + F.col("m") - F.col("c"))).where(F.col("similarity") >= similarity - 1e-9)
    best = score.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("start"), "n")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.start")).cast("long").alias("start_word"),
                       F.col("b.n").cast("long").alias("n_runs"), F.round("b.similarity", 6).alias("similarity"))


def without_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` in which no benchmark item is found, columns as they are. Rows that share a doc_id share their fate; a null doc_id is one."""
    bad = contaminated(documents, benchmark).select(F.struct("doc_id").alias("_k")).distinct()
    rows = documents.select(F.struct("*").alias("_row"), F.struct("doc_id").alias("_d"))
    return rows.join(bad, rows["_d"] == bad["_k"], "left_anti").select("_row.*")
