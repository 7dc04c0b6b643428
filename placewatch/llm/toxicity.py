"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct words, lower-cased and without marks at their
ends, and the beginnings of longer words; each is hashed to 32 bits. The model
holds the hashes that go with either label more often than chance allows, and
weighs each of them and, by factors, every pair of them in a text, so an
insult counts more beside a mention of a group.
"""

from __future__ import annotations

import dataclasses
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_process
from .learn import Model, fit, labelled, probability, sparse_rows

#: Lengths of beginnings that are terms.
BEGINNINGS = (4, 5)
#: Least texts with a term, least distance from chance in standard deviations, most terms in the model, factors of a term.
LEAST_TEXTS, LEAST_Z, MOST_TERMS, FACTORS = 4, 4.0, 20_000, 6
#: Words whose terms a worker keeps.
CACHED = 100_000
MARKS = ".,;:!?\"'()[]{}*#$%&|<>-"


def hashes(word: str) -> tuple[int, ...]:
    term = word.strip(MARKS)
    names = [f"w{term}", *(f"b{term[:n]}" for n in BEGINNINGS if len(term) > n)]
    return tuple(zlib.crc32(x.encode("utf-8", "replace")) for x in names) if term else ()


def terms(text: str) -> np.ndarray:
    """Hashes of a whole text, each once, as signed 32-bit integers."""
    found = {h for word in set(text.lower().split()) for h in hashes(word)}
    return np.array(sorted(found), np.uint32).view(np.int32)


@dataclasses.dataclass
class ToxicityModel:
    model: Model
    place: dict[int, int]
    name: str = ""

    def score(self, text: str) -> float:
        known = per_process("toxicity", lambda: _Known(self.place, self.name))
        if known.name != self.name:  # of another model
            known.clear()
            known.place, known.name = self.place, self.name
        found: set[int] = set()
        for at in map(known.__getitem__, set(text.lower().split())):
            found.update(at)
        return float(probability(self.model.score(np.array(sorted(found), np.int64))))


class _Known(dict):
    """Places in the model of a word's terms."""

    def __init__(self, place: dict[int, int], name: str):
        super().__init__()
        self.place, self.name = place, name

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHED:
            self.clear()
        self[word] = found = tuple(self.place[h] for h in hashes(word) if h in self.place)
        return found


def telling(at: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The hashes whose texts have another share of label 1 than all texts, by ``LEAST_Z`` standard deviations."""
    if not len(y):
        return np.empty(0, np.int32)
    every, row = np.concatenate(at), np.repeat(np.arange(len(at)), [len(a) for a in at])
    known, place = np.unique(every, return_inverse=True)
    n, ones, share = np.bincount(place), np.bincount(place, y[row]), y.mean()
    z = np.abs(ones - n * share) / np.sqrt(np.maximum(n * share * (1 - share) * (1 - n / (len(y) + 1)), 1e-9))
    z[n < LEAST_TEXTS] = 0
    best = np.argsort(-z, kind="stable")[:MOST_TERMS]
    return known[np.sort(best[z[best] >= LEAST_Z])]


def learn_toxicity(documents: DataFrame, labels: DataFrame, rows: int = 8_000) -> ToxicityModel:
    """The model from at most ``rows`` labelled documents, none of whose ids has a CRC-32 (as text) divisible by 5. No labels: every score is 0.5."""
    learned_from = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    at, _, y, _ = sparse_rows(labelled(documents, labels, "toxic", rows, learned_from), lambda t: (terms(t), np.empty(0)))
    kept = telling(at, y)
    place = {int(h): i for i, h in enumerate(kept.view(np.uint32))}
    own = [np.flatnonzero(np.isin(kept, a, assume_unique=True)) for a in at]
    model = fit(own, [np.ones(len(a)) for a in own], y, len(kept), FACTORS, epochs=30) if len(y) else Model(0.0, np.zeros(0, np.float32))
    return ToxicityModel(model, place, str(zlib.crc32(model.weights.tobytes() + kept.tobytes())))


def score_toxicity(documents: DataFrame, model: ToxicityModel, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carried`` columns and ``score`` (0 to 1), a row for each row. A null text scores like an empty one; only texts are read."""
    kept = documents.select(*carried, F.coalesce("text", F.lit("")).alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in documents.select(*carried).dtypes) + ", score double"
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_TERMS

    def scored(batches):
        import pyarrow as pa

        for batch in batches:
            out = [shared.value.score(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], [*carried, "score"])

    return kept.mapInArrow(scored, schema)


def without_toxic(documents: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of ``documents`` that score under ``limit``, columns as they are; nulls, repeated rows and empty tables as in ``score_toxicity``."""
    model = learn_toxicity(documents, labels)
    rows = documents.select(F.struct("*").alias("row"), "text")
    return score_toxicity(rows, model, ("row",)).where(F.col("score") < limit).select("row.*")
