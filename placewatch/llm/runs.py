"""Maximal repetitions of words inside a text, found by recompression.

Documents of an Arrow batch are laid side by side as numbers of their words,
each followed by a mark that occurs once. Rounds of block compression (k equal
neighbours become one symbol with exponent k) and pair compression (symbols are
dealt into left and right by a hash, every left-right pair becomes one symbol)
shrink that row until each document is one symbol: a run-length grammar, kept
as one level per round. Equal stretches are cut in the same way on each level
but for a symbol at their ends, so the longest common extension of two places
climbs while they agree and descends where they differ, with a few steps per
level: exact, without suffix arrays, for all candidates of a batch at once.

A run of period p and at least 3 p words holds the places i, i + p and i + 2 p
for some i on the grid 0, p, 2 p, ...; a candidate is a pair (i, i + p) of such
a triple of equal words. Grids of all periods have about n log n places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of documents that are worked on together; a longer document goes alone.
TOGETHER = 1 << 19
#: Periods up to this are looked up place by place, longer ones by grid step.
SHORT = 24
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


class Level:
    """One row of symbols: how each is named, which symbol of the next level holds it, and where that one begins."""

    def __init__(self, names: np.ndarray, parent: np.ndarray | None = None, block: bool = False):
        self.names, self.parent, self.block = names, parent, block
        self.first = None
        if parent is not None:
            ends = np.flatnonzero(np.diff(parent)) + 1
            self.first = np.concatenate([[0], ends, [len(parent)]]).astype(np.int64)

    def mirrored(self) -> Level:
        parent = self.parent
        return Level(self.names[::-1], None if parent is None else parent[-1] - parent[::-1], self.block)


def _named(key: np.ndarray, least: int) -> np.ndarray:
    """Equal keys get equal names, from ``least`` on."""
    return np.unique(key, return_inverse=True)[1] + least


def grammar(names: np.ndarray, marks: int) -> list[Level]:
    """Levels of the row; names under ``marks`` are ends of documents and never join others."""
    levels, least, number = [], int(names.max(initial=0)) + 1, 0
    while True:
        before = len(names)
        for block in (True, False):
            number += 1
            joined = np.zeros(len(names), bool)        # to the symbol on the left
            if block:
                joined[1:] = names[1:] == names[:-1]
            else:
                with np.errstate(over="ignore"):
                    x = (names.astype(np.uint64) + np.uint64(number << 40)) * np.uint64(0x9E3779B97F4A7C15)
                    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left = (x >> np.uint64(47)) & np.uint64(1) == 1
                word = names >= marks
                joined[1:] = left[:-1] & ~left[1:] & word[:-1] & word[1:]
            if not joined.any():
                continue
            parent = np.cumsum(~joined) - 1
            levels.append(Level(names, parent, block))
            first = levels[-1].first
            length = np.diff(first)
            above = names[first[:-1]].copy()
            many = np.flatnonzero(length > 1)
            other = length[many] if block else names[first[many] + 1]
            above[many] = _named(above[many] * (int(other.max()) + 1) + other, least)
            least += len(many)
            names = above
        if len(names) == before:
            # A round of bad luck may join nothing; the row is done when marks stand between all symbols.
            if not ((names[1:] >= marks) & (names[:-1] >= marks)).any():
                break
    return [*levels, Level(names)]


def extension(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols of the lowest level are equal from places a and b on; a mark ends every extension."""
    start, a, b = a, a.copy(), b.copy()
    top = np.full(len(a), -1)                           # the level where the pair was found to differ
    live = np.arange(len(a))
    for n, level in enumerate(levels[:-1]):
        x, y = a[live], b[live]
        differ = np.zeros(len(live), bool)
        for _ in range(1 if level.block else 2):
            at = ~differ & ((level.first[level.parent[x]] != x) | (level.first[level.parent[y]] != y))
            differ |= at & (level.names[x] != level.names[y])
            at &= ~differ
            if level.block:
                left = level.first[level.parent[x] + 1] - x
                right = level.first[level.parent[y] + 1] - y
                step = np.where(at, np.minimum(left, right), 0)
                differ |= at & (left != right)
            else:
                step = at.astype(np.int64)
            x, y = x + step, y + step
        a[live], b[live] = np.where(differ, x, level.parent[x]), np.where(differ, y, level.parent[y])
        top[live[differ]] = n
        live = live[~differ]
    last = levels[-1]
    top[live] = len(levels) - 1
    while len(live := live[last.names[a[live]] == last.names[b[live]]]):
        a[live] += 1
        b[live] += 1
    for n in range(len(levels) - 2, -1, -1):
        live = np.flatnonzero(top > n)
        level = levels[n]
        pa, pb = a[live], b[live]
        x, y = level.first[pa], level.first[pb]
        same = level.names[x] == level.names[y]
        step = np.minimum(level.first[pa + 1] - x, level.first[pb + 1] - y) if level.block else 1
        a[live], b[live] = np.where(same, x + step, x), np.where(same, y + step, y)
    return a - start


def candidates(names: np.ndarray, begins: np.ndarray, sizes: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of grid pairs (i, i + p) that a run of ``times`` p words may hold, documents side by side."""
    places, periods = [], []
    most = sizes // times
    document = np.repeat(np.arange(len(sizes)), sizes)
    own = np.arange(len(document)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = begins[document] + own
    for p in range(1, min(SHORT, int(most.max(initial=0))) + 1):
        grid = np.flatnonzero((own % p == 0) & (own + (times - 1) * p < sizes[document]))
        i = at[grid]
        for k in range(1, times):
            i = i[names[i] == names[i + k * p]]
        places.append(i)
        periods.append(np.full(len(i), p))
    # Longer periods: (document, period) pairs, one grid step after another, while the period fits.
    count = np.maximum(most - SHORT, 0)
    whose = np.repeat(np.arange(len(sizes)), count)
    p = np.arange(len(whose)) - np.repeat(np.cumsum(count) - count, count) + SHORT + 1
    i, ends = begins[whose].copy(), (begins + sizes)[whose]
    while len(p):
        fits = i + (times - 1) * p < ends
        if not fits.all():
            p, i, ends = p[fits], i[fits], ends[fits]
        hit = names[i] == names[i + p]
        hit = np.flatnonzero(hit)
        for k in range(2, times):
            hit = hit[names[i[hit]] == names[i[hit] + k * p[hit]]]
        places.append(i[hit])
        periods.append(p[hit])
        i = i + p
    return np.concatenate([*places, []]).astype(np.int64), np.concatenate([*periods, []]).astype(np.int64)


def runs_of(names: np.ndarray, sizes: np.ndarray, least: int, times: int) -> tuple[np.ndarray, ...]:
    """Runs of documents laid side by side: document, start, length, period, in that order.

    ``names`` numbers words; documents have ``sizes`` words.
    """
    n = len(sizes)
    # Marks are 0 to n, one before the first document, then one after each.
    row = np.empty(len(names) + n + 1, np.int64)
    begins = np.cumsum(sizes + 1) - sizes
    is_mark = np.zeros(len(row), bool)
    is_mark[0] = True
    is_mark[begins + sizes] = True
    row[is_mark] = np.arange(n + 1)
    row[~is_mark] = names + n + 1
    i, p = candidates(row, begins, sizes, times)
    if not len(i):
        return (np.zeros(0, np.int64),) * 4
    # A grammar only of the documents with candidates.
    document = np.searchsorted(begins, i, "right") - 1
    some = np.unique(document)
    parts = [row[:1], *[row[b:b + s + 1] for b, s in zip(begins[some], sizes[some])]]
    levels = grammar(np.concatenate(parts), n + 1)
    moved = np.cumsum(sizes[some] + 1) - sizes[some]
    i = i - begins[document] + moved[np.searchsorted(some, document)]
    size = len(levels[0].names)
    ahead = extension(levels, i, i + p)
    # Backwards from the words before: the same levels read from right to left.
    back = extension([x.mirrored() for x in levels], size - i, size - i - p)
    length = ahead + back + p
    good = (length >= least) & (length >= times * p)
    start, length, p, document = (i - back)[good], length[good], p[good], document[good]
    # A stretch found with several periods has the least one: the others are its multiples.
    order = np.lexsort((p, length, start))
    start, length, p, document = start[order], length[order], p[order], document[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, p, document = start[new], length[new], p[new], document[new]
    start = start - moved[np.searchsorted(some, document)]
    order = np.lexsort((p, start, document))
    return document[order], start[order], length[order], p[order]


def _kept(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """Words outside the repeats of all runs, joined by a space."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    keep = np.cumsum(change[:-1]) == 0
    return b" ".join([words[k] for k in np.flatnonzero(keep)])


def periodic_runs(documents: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """All columns, with ``_runs`` (start, length and period in words, by start, then period) and ``_collapsed``.

    A run is a stretch of words with smallest period p that no neighbouring word
    extends, of ``least`` and of ``times`` (3 or more) p words at least.
    ``_collapsed`` are the words that are not in a run after its first p words,
    joined by a space: text without its repeats. Words lie between the white
    space characters 9 to 13 and 32, compared as bytes. A null or empty text has
    no runs and collapses to the empty text; rows are treated one by one, so
    repeated rows and null ids make no difference; an empty table gives an empty
    one. Columns of the documents with these two names are replaced. A text is
    worked on in one task, in memory of about 300 bytes a word.
    """
    if times < 3:
        raise ValueError("the grid holds runs of three periods or more")
    kept = [c for c in documents.columns if c not in ("_runs", "_collapsed")]
    schema = T.StructType([f for f in documents.schema.fields if f.name in kept])
    schema = schema.add("_runs", T.ArrayType(RUN)).add("_collapsed", "string")

    def found(texts: list[bytes]) -> tuple[list, list]:
        import pandas as pd

        words = [t.split() for t in texts]      # bytes split at exactly these characters
        runs, collapsed = [[] for _ in texts], [None] * len(texts)
        some = [k for k, w in enumerate(words) if len(w) >= max(least, times)]
        if some:
            sizes = np.array([len(words[k]) for k in some], np.int64)
            flat = np.empty(int(sizes.sum()), object)
            flat[:] = [w for k in some for w in words[k]]
            d, start, length, period = runs_of(pd.factorize(flat)[0].astype(np.int64), sizes, least, times)
            cuts = np.flatnonzero(np.diff(d)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(d)]) if len(d) else ():
                k = some[d[low]]
                own = start[low:high], length[low:high], period[low:high]
                runs[k] = [{"start": s, "length": n, "period": p} for s, n, p in zip(*[x.tolist() for x in own])]
                collapsed[k] = _kept(words[k], *own)
        return runs, [b" ".join(w) if c is None else c for w, c in zip(words, collapsed)]

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            text = batch.column(batch.num_columns - 1).cast(pa.binary())
            # About a word per two bytes at most.
            sizes = np.diff(np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1]) // 2 if len(text) else []
            group = np.cumsum(sizes) // TOGETHER
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(text)] if len(text) else [0]
            for low, high in zip(cuts, cuts[1:]):
                runs, collapsed = found(text.slice(low, high - low).to_pylist())
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(runs, kind), pa.array(collapsed, pa.binary()).cast(pa.string())],
                                                 [*schema.names])

    return documents.select(*kept, F.coalesce("text", F.lit("")).alias("_text")).mapInArrow(work, schema)
