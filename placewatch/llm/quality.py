"""Quality rules: counts of the whole text, and a calibrated logistic regression on hashed words and character n-grams."""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learn import Model, calibrated, fit, labelled, probability, sparse_rows

#: Buckets of words and of byte n-grams; lengths of the n-grams. Features are shares of a text, scaled.
WORD_BUCKETS, GRAM_BUCKETS, GRAMS, SCALE = 2**12, 2**13, (1, 2, 3), 20.0
SYMBOLS = b"#*$%&|<>"
#: Least words, words of a window, most words in repeated windows (per cent).
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True


@dataclasses.dataclass
class QualityModel:
    model: Model
    slope: float
    intercept: float

    def probability(self, text: str) -> float:
        return float(probability(self.slope * self.model.score(*features(text)) + self.intercept))


def repeated_words(words: list) -> int:
    """Words that lie in a window of ``WINDOW`` words found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    known: dict = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(known) == len(words):
        return 0
    # Numbers of equal runs of 2, 4 and 8 words, exactly.
    for w in (1, 2, 4):
        ids = np.unique(ids[:-w] * (ids.max() + 1) + ids[w:], return_inverse=True)[1]
    again = np.bincount(ids)[ids] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    covered[:n] += again
    covered[WINDOW:] -= again
    return int((np.cumsum(covered) > 0).sum())


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = text.encode("utf-8", "replace")
    data = np.frombuffer(raw, np.uint8)
    words = raw.split()
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += bool(line.strip())
        else:
            seen.add(line)
    chars = int(((data & 0xC0) != 0x80).sum() - _IS_SPACE[data].sum())
    return len(words), chars, int(_IS_SYMBOL[data].sum()), dup, repeated_words(words)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and scaled shares of words (lower-cased in A-Z) and byte n-grams of a whole text; none for an empty one."""
    raw = text.encode("utf-8", "replace")
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.empty(0, np.int64), np.empty(0)
    total = np.zeros(WORD_BUCKETS + GRAM_BUCKETS)
    # A word's hash: the sum of its bytes times powers of an odd number, moved to power 0; one running sum serves all words.
    low = np.frombuffer(raw.lower(), np.uint8).astype(np.uint64) + np.uint64(1)
    word = ~_IS_SPACE[data]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(starts):
        power, back = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(low) - 1, power)]))
        backs = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(low) - 1, back)]))
        run = np.concatenate([[np.uint64(0)], np.cumsum(low * powers)])
        h = (run[ends] - run[starts]) * backs[starts]
        h ^= h >> np.uint64(29)
        total[:WORD_BUCKETS] = np.bincount((h * power >> np.uint64(64 - 12)).astype(np.int64), minlength=WORD_BUCKETS) * (SCALE / len(starts))
    gram = np.zeros(len(data), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if n > len(data):
            break
        gram = (gram[:len(data) - n + 1] * np.uint32(257) + data[n - 1:].astype(np.uint32) + np.uint32(1))
        if n in GRAMS:
            h = ((gram + np.uint32(n)) * np.uint32(2654435769)) >> np.uint32(32 - 13)
            total[WORD_BUCKETS:] += np.bincount(h, minlength=GRAM_BUCKETS) * (SCALE / len(GRAMS) / len(gram))
    at = np.flatnonzero(total)
    return at, total[at]


def learn_quality(documents: DataFrame, labels: DataFrame, rows: int = 5_000) -> QualityModel:
    """The model from at most ``rows`` labelled documents; a fifth of them (by id) only calibrates. No labels: every probability is 0.5."""
    at, x, y, ids = sparse_rows(labelled(documents, labels, "quality", rows), features)
    if not len(y):
        return QualityModel(Model(0.0, np.zeros(WORD_BUCKETS + GRAM_BUCKETS, np.float32)), 1.0, 0.0)
    apart = ids % 5 == 0
    learn = np.flatnonzero(~apart) if (~apart).any() else np.arange(len(y))
    model = fit([at[k] for k in learn], [x[k] for k in learn], y[learn], WORD_BUCKETS + GRAM_BUCKETS, epochs=20, rate=0.2)
    check = np.flatnonzero(apart) if apart.any() else learn
    return QualityModel(model, *calibrated(np.array([model.score(at[k], x[k]) for k in check]), y[check]))


def judge_quality(documents: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``quality`` (probability of label 1) and ``kept``: the base holds and ``quality >= least``.

    A row for each row; a null text is an empty one and fails the base, as any
    text of under 20 words does. Other columns are ignored.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shared = documents.sparkSession.sparkContext.broadcast(model)  # its size is fixed by the buckets

    def judged(batches):
        import pyarrow as pa

        for batch in batches:
            out = [(*counts(t := v.as_py()), shared.value.probability(t)) for v in batch.column(1)]
            columns = [pa.array([r[k] for r in out], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([r[5] for r in out], pa.float64())], ["doc_id", *names, "quality"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    scored = rows.mapInArrow(judged, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", quality double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return scored.select("doc_id", *names, failed.alias("base_failed"), "quality", (~failed & (F.col("quality") >= least)).alias("kept"))
