"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints within ``radius`` bits
have a segment in which they differ by at most ``radius // segments`` bits;
with two such bits the Hamming balls of radius 1 around both segments meet.
So each fingerprint enters a table under every segment of its balls, looks up
the same keys, and complete distances are verified where rows meet.

No pair is made inside a group of near copies but what joins it: first each
fingerprint meets the smallest one of its keys, then only pairs between
different components are left to look for.

``one_of_each`` adds an exact source of candidates, as fingerprints alone miss
similar texts: two sets of a Jaccard similarity have an element in common among
the first few of each in any order of all elements (prefix filter). The order
puts elements first that are rare in a sample; the sample decides on speed only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_shuffle, stored
from .components import components

#: The seed of the shingle hashes, XXH64.
SEED = 42
#: Distinct values whose 0/1 columns a task holds at a time.
COLUMNS = 4096
#: About so many documents are sampled for common shingles; those in so many of them are common, and so many of these at most are broadcast.
SAMPLED, COMMON, MOST_COMMON = 4096, 3, 200_000
#: Longs of the parities of a set: bit i is the parity of the elements that are i modulo all bits. The second are for pairs that pass the first.
PARITY, WIDE = 16, 128


def _hashes(text: str, words: int, distinct: bool) -> np.ndarray:
    """XXH64 of each word shingle of the text, lower-cased in A-Z; of all words together if there are fewer; none without words."""
    import xxhash

    parts = text.encode("utf-8", "replace").lower().split()  # splits at space and control characters 9 to 13
    if not parts:
        return np.empty(0, np.uint64)
    if distinct:
        shingles = {b" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))}
        return np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64)
    joined, sizes = b" ".join(parts), np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    words = min(words, len(parts))
    return np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:len(parts) - words + 1].tolist(), ends[words - 1:].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes; 0 without hashes. As a signed 64-bit integer."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    # Sums of bytes are cheap; 255 rows at a time fit them.
    ones = np.add.reduceat(bits.reshape(-1, 64), np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, words: int = 4, distinct: bool = False, carried: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``carried`` columns and ``fp`` (long), a row for each row. Null and empty texts have fingerprint 0; whole texts are read."""
    kept = df.select(*carried, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*carried).dtypes) + ", fp long"

    def hashed(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            fps = pa.array([fingerprint(_hashes(t.as_py(), words, distinct)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fps], [*carried, "fp"])

    return kept.mapInArrow(hashed, schema)


def differing_bits(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _keyed(nodes: DataFrame, segments: int) -> DataFrame:
    """A row for each key of a node: a segment's number and one value of its ball of radius 1."""
    bounds = [64 * j // segments for j in range(segments + 1)]
    keys = [f"((shiftrightunsigned(fp, {low}) & {(1 << (high - low)) - 1}L) ^ {flip}L) | {j << 40}L"
            for j, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)) for flip in [0, *(1 << i for i in range(high - low))]]
    return nodes.withColumn("key", F.explode(F.expr(f"array({', '.join(keys)})")))


def linked(nodes: DataFrame, radius: int = 4, segments: int = 2) -> DataFrame:
    """``node`` and ``root`` for each node that has a link: another fingerprint within ``radius`` bits.

    ``nodes``: ``node`` (unique, not null) and ``fp`` (long). ``radius //
    segments`` has to be 2 at most.
    """
    if radius // segments > 2 or segments < 2:
        raise ValueError("balls of radius 1 meet up to 2 differing bits in a segment")
    other = _keyed(nodes, segments).select("key", F.col("node").alias("o_node"), F.col("fp").alias("o_fp"))
    mine = _keyed(nodes, segments)
    some = mine.join(by_shuffle(other), (mine["key"] == other["key"]) & (F.col("node") != F.col("o_node")) & (differing_bits("fp", "o_fp") <= radius), "left_semi")
    near = stored(some.select("node", "fp").distinct(), "near")

    # Each node and the smallest node of a key.
    least = F.min(F.struct("node", "fp")).over(Window.partitionBy("key"))
    star = _keyed(near, segments).withColumn("least", least).where((F.col("node") != F.col("least.node")) & (differing_bits("fp", "least.fp") <= radius))
    first = components(star.select(F.col("node").alias("a"), F.col("least.node").alias("b")).distinct())
    # Pairs that would join two components: keys under which only one component is met are done.
    named = near.join(by_shuffle(first), "node", "left").select("node", "fp", F.coalesce("root", "node").alias("root"))
    by_key = Window.partitionBy("key")
    open_keys = (_keyed(named, segments).withColumns({"low": F.min("root").over(by_key), "high": F.max("root").over(by_key)})
                 .where("low != high").select("key", "node", "fp", "root"))
    other = open_keys.select("key", *[F.col(c).alias(f"o_{c}") for c in ("node", "fp", "root")])
    met = open_keys.join(by_shuffle(other), (open_keys["key"] == other["key"]) & (F.col("root") < F.col("o_root")) & (differing_bits("fp", "o_fp") <= radius))
    rest = stored(met.select(F.col("node").alias("a"), F.col("o_node").alias("b")).distinct(), "links")
    if rest.isEmpty():
        return first
    return components(rest.unionByName(first.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def near_duplicates(df: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` for each row: the smallest doc_id reachable over links.

    Fingerprints of word shingles, repeats included, link at ``radius`` or
    fewer differing bits; equal fingerprints always do. Null, empty and
    wordless texts have fingerprint zero and link like others. A null doc_id
    keeps its fingerprint and takes the component of the others; a component
    of null doc_ids only is null. Repeated rows stay. An empty table gives no row.
    """
    rows = stored(fingerprints(df, words), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked_fps = linked(classes.select(F.col("fp").alias("node"), "fp"), radius)
    named = classes.join(by_shuffle(linked_fps), classes["fp"] == linked_fps["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = named.join(by_shuffle(least), "root").select("fp", "component_id")
    return rows.join(by_shuffle(of_fp), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set on the left with each other one on the right; the same list may stand on both sides."""
    out = np.zeros((len(left), len(right)), np.float32)
    values = np.concatenate([*left, *right])
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    enough = times > (2 if left is right else 1)  # a value of one set only is in no intersection
    shared, number = enough[column], np.cumsum(enough) - 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        has = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        has[row[a:b], column[a:b] - low] = 1
        out += has[:len(left)] @ has[len(left):].T
    return out


def _joined(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest over sets with a Jaccard similarity of ``similarity`` or more.

    With sets on the right, which are numbered behind the left ones, only pairs across count.
    """
    n, m = len(left), len(right)
    both = _overlaps(left, right or left)
    sizes = np.array([len(s) for s in left]), np.array([len(s) for s in right or left])
    near = both >= similarity * (sizes[0][:, None] + sizes[1][None, :] - both)  # two empty sets are alike
    if right:
        near = np.block([[np.zeros((n, n), bool), near], [near.T, np.zeros((m, m), bool)]])
    new = np.ones(n + m, bool)
    for start in range(n + m):
        if not new[start]:
            continue
        new[start] = False
        front = np.array([start])
        while len(front):
            reached = near[front].any(axis=0) & new
            new &= ~reached
            front = np.flatnonzero(reached)
            yield from ((start, int(x)) for x in front)


def similar(blobs: DataFrame, sets: DataFrame, similarity: float, most: int = 1000, most_values: int = 2_000_000) -> DataFrame:
    """``a``, ``b``: edges that join all nodes of a blob whose sets reach the similarity; as many as nodes, not as pairs.

    ``blobs``: ``node``, ``root``; ``sets``: ``node``, ``s``. A blob is cut
    into blocks of about ``most`` nodes and ``most_values`` values, and each
    two blocks meet in a task, where products of 0/1 matrices give all overlaps.
    """
    rows = by_shuffle(blobs).join(sets, "node")
    sizes = rows.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.size("s")).alias("v"))
    blocks = sizes.select("root", F.greatest(F.lit(1), F.ceil(F.col("n") / most), F.ceil(F.col("v") / most_values)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (rows.join(by_shuffle(blocks), "root").withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "s"))

    def meet(batches) -> Iterator:
        import pyarrow as pa

        def met(key, group):
            ids, mine = [g[1] for g in group], [g[0] == key[1] for g in group]
            left, right = [g[2] for g, x in zip(group, mine, strict=True) if x], [g[2] for g, x in zip(group, mine, strict=True) if not x]
            names = [i for i, x in zip(ids, mine, strict=True) if x] + [i for i, x in zip(ids, mine, strict=True) if not x]
            if key[1] != key[2] and not (left and right):
                return []  # one of two blocks is empty
            return [(names[a], names[b]) for a, b in _joined(left, right, similarity)]

        def written(found):
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

        key, group, found = None, [], []
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True))
            owns, ids, lists = batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)
            for r, k in enumerate(keys):
                if k != key:
                    found += met(key, group) if group else []
                    key, group = k, []
                    if len(found) >= 50_000:
                        yield written(found)
                        found = []
                group.append((owns[r], ids[r], lists[r].values.to_numpy()))
        found += met(key, group) if group else []
        if found:
            yield written(found)

    together = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    return together.mapInArrow(meet, "a long, b long")


def _shingle_sets(documents: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``node`` and its set of shingle hashes; ``nodes`` has ``node`` and the ``doc_id`` and ``_digest`` of a row with its text."""
    def shingles(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [np.unique(_hashes(t.as_py(), words, False)).astype(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "s"])

    text = F.coalesce("text", F.lit(""))
    texts = documents.select("doc_id", F.md5(text).alias("_digest"), text.alias("text")).join(by_shuffle(nodes), ["doc_id", "_digest"])
    one = texts.groupBy("node").agg(F.min("text").alias("text"))
    return one.mapInArrow(shingles, "node long, s array<long>")


def _common(documents: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that many sampled documents have, in order, and how many of them. Bounded by ``MOST_COMMON``."""
    def shingles(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_hashes(t.as_py(), words, False)).view(np.int64))], ["x"])

    every = max(1, documents.count() // SAMPLED)
    some = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select(F.coalesce("text", F.lit("")))
    counts = some.mapInArrow(shingles, "x long").groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    got = counts.orderBy(F.desc("n"), "x").limit(MOST_COMMON).toArrow()
    x, n = got.column("x").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(x)
    return x[order], n[order]


def _first_shingles(s: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """So many elements of a set, rare ones first, that a set of ``similarity`` has one of its own first elements among them."""
    x, n = common
    times = np.zeros(len(s), np.int64)
    if len(x):
        at = np.minimum(np.searchsorted(x, s), len(x) - 1)
        times = np.where(x[at] == s, n[at], 0)
    enough = int(np.ceil(similarity * len(s) - 1e-9))
    return s[np.lexsort((s, times))][:len(s) - enough + 1]


def _parity(s: np.ndarray, longs: int) -> np.ndarray:
    return np.packbits((np.bincount(s & (64 * longs - 1), minlength=64 * longs) & 1).astype(np.uint8), bitorder="little").view("<i8")


def _wide(sets: DataFrame) -> DataFrame:
    """``node``, ``n`` and ``parity`` of ``WIDE`` longs of each set."""
    def made(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [x.values.to_numpy() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int32()),
                                              pa.array([_parity(x, WIDE) for x in found], pa.list_(pa.int64()))], ["node", "n", "parity"])

    return sets.select("node", "s").mapInArrow(made, "node long, n int, parity array<long>")


def _close(pairs: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """The pairs that may reach the similarity: parities differ in as many bits at most as there are elements that only one of two sets has."""
    left = prints.select(F.col("node").alias("a"), "n", "parity")
    right = prints.select(F.col("node").alias("b"), F.col("n").alias("o_n"), F.col("parity").alias("o_parity"))
    bits = F.aggregate(F.zip_with("parity", "o_parity", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    may = bits - 1e-6 <= (F.col("n") + F.col("o_n")) * ((1 - similarity) / (1 + similarity))
    return pairs.join(by_shuffle(left), "a").join(by_shuffle(right), "b").where(may).select("a", "b").distinct()


def _prints(documents: DataFrame, words: int, similarity: float) -> DataFrame:
    """``doc_id``, ``_digest``, ``fp`` of the distinct words, ``n`` shingles, the first ones of them, ``firsts``, and their ``parity``, for each row."""
    common = documents.sparkSession.sparkContext.broadcast(_common(documents, words))
    text = F.coalesce("text", F.lit(""))

    def made(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps, sizes, firsts, parities = [], [], [], []
            for t in batch.column(2):
                s = np.unique(_hashes(t.as_py(), words, False)).view(np.int64)
                s.sort()
                fps.append(fingerprint(_hashes(t.as_py(), 1, True)))
                sizes.append(len(s))
                firsts.append(_first_shingles(s, common.value, similarity))
                parities.append(_parity(s, PARITY))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()),
                                              pa.array(firsts, pa.list_(pa.int64())), pa.array(parities, pa.list_(pa.int64()))],
                                             ["doc_id", "_digest", "fp", "n", "firsts", "parity"])

    kept = documents.select("doc_id", F.md5(text).alias("_digest"), text.alias("_text"))
    return kept.mapInArrow(made, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, _digest string, fp long, n int, firsts array<long>, parity array<long>")


def _across(documents: DataFrame, rows: DataFrame, nodes: DataFrame, roots: DataFrame, words: int, similarity: float) -> DataFrame:
    """``a``, ``b``: all pairs of nodes of different ``roots`` whose sets reach the similarity, by the first shingles of each."""
    own = (rows.select("doc_id", "_digest", "n", "firsts", "parity").join(by_shuffle(nodes.select("doc_id", "_digest", "node")), ["doc_id", "_digest"])
           .drop("doc_id", "_digest").dropDuplicates(["node"]).join(by_shuffle(roots), "node", "left").withColumn("root", F.coalesce("root", "node")))
    keyed = own.select("node", "root", "n", F.posexplode("firsts").alias("at", "key"))
    by_key = Window.partitionBy("key")
    # Keys under which only one component is met are done.
    open_keys = stored(keyed.withColumns({"low": F.min("root").over(by_key), "high": F.max("root").over(by_key)})
                       .where("low != high").select("key", "node", "root", "n", "at"), "first-shingles")
    other = open_keys.select(*[F.col(c).alias(f"o_{c}") for c in open_keys.columns])
    # As many as both may have in common: what lies before the key in both, the key, and what lies behind it in both.
    most = F.least("at", "o_at") + F.least(F.col("n") - F.col("at"), F.col("o_n") - F.col("o_at"))
    met = open_keys.join(by_shuffle(other), (F.col("key") == F.col("o_key")) & (F.col("root") < F.col("o_root"))
                         & (most + 1e-6 >= similarity * (F.col("n") + F.col("o_n") - most)))
    met = met.select(F.col("node").alias("a"), F.col("o_node").alias("b")).distinct()
    pairs = stored(_close(met, own.select("node", "n", "parity"), similarity), "pairs")
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = stored(_shingle_sets(documents, nodes.select("node", "doc_id", "_digest").join(by_shuffle(asked), "node", "left_semi"), words), "pair-shingles")
    # Whole sets travel only with the pairs that are left.
    pairs = stored(_close(pairs, stored(_wide(sets), "wide"), similarity), "pairs")
    both = (pairs.join(by_shuffle(sets.select(F.col("node").alias("a"), F.col("s").alias("s"))), "a")
            .join(by_shuffle(sets.select(F.col("node").alias("b"), F.col("s").alias("o_s"))), "b"))
    shared = F.size(F.array_intersect("s", "o_s"))
    return both.where(shared >= similarity * (F.size("s") + F.size("o_s") - shared)).select("a", "b")


def one_of_each(documents: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 8, segments: int = 3) -> DataFrame:
    """The rows of ``documents`` but those of which a near-duplicate with a smaller doc_id stays; columns as they are.

    Documents are linked if their sets of ``words``-word shingles (lower-cased
    in A-Z; fewer words: all of them) have a Jaccard similarity of
    ``similarity`` or more; equal texts always are, texts without words too.
    First candidates are components of fingerprints of the distinct words
    within ``radius`` bits: scattered edits move these far less than fingerprints
    of long shingles. Inside them all similarities are exact. Similar texts that
    are further apart are all found by their rarest shingles (see ``_across``),
    so no link is lost. The smallest doc_id of each component stays, of several texts
    under it the one with the least digest. Rows that share a doc_id but are not
    alike are documents of their own and all stay; of repeated rows one does.
    Rows with a null doc_id stay. An empty table gives no row.
    """
    known = documents.where("doc_id IS NOT NULL")
    rows = stored(_prints(known, words, similarity), "fingerprints")
    # Equal texts are one node; the number of its row in the written table names it, as a doc_id may stand for several texts.
    named = stored(rows.groupBy("_digest", "fp").agg(F.min("doc_id").alias("doc_id")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    blobs = stored(linked(named.select("node", "fp"), radius, segments), "blobs")
    inside = named.select("node", "doc_id", "_digest").join(by_shuffle(blobs.select("node")), "node", "left_semi")
    roots = components(similar(blobs, stored(_shingle_sets(known, inside, words), "shingles"), similarity))
    more = stored(_across(known, rows, named, roots, words, similarity), "links")
    if not more.isEmpty():
        roots = components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    keep = (named.join(by_shuffle(roots), "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
            .agg(F.min(F.struct("doc_id", "_digest")).alias("_kept")).select("_kept.*"))
    # One row for each document that stays.
    first = F.row_number().over(Window.partitionBy("_doc", "_digest").orderBy(F.lit(0)))
    wide = known.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), F.md5(F.coalesce("text", F.lit(""))).alias("_digest"))
    kept = keep.withColumnRenamed("doc_id", "_doc")
    stays = wide.join(by_shuffle(kept), ["_doc", "_digest"], "left_semi").withColumn("_n", first).where("_n = 1").select("_row.*")
    return stays.unionByName(documents.where("doc_id IS NULL"))
