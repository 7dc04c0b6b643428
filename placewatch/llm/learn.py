"""Small linear and factorization models on sparse rows, fitted to a bounded sample of labelled documents."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclasses.dataclass
class Model:
    """Score of a sparse row x: ``bias + w.x``, and with factors half of ``|V'x|^2 - sum of |v_i x_i|^2``: a weight for each pair of terms."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray | None = None

    def score(self, at: np.ndarray, x: np.ndarray | float = 1.0) -> float:
        out = self.bias + float(np.dot(self.weights[at], np.broadcast_to(x, len(at))))
        if self.factors is not None and len(at):
            v = self.factors[at] * np.broadcast_to(x, len(at))[:, None]
            out += 0.5 * float((v.sum(axis=0) ** 2).sum() - (v * v).sum())
        return out


def probability(score):
    return 1 / (1 + np.exp(-np.clip(score, -35, 35)))


def labelled(documents: DataFrame, labels: DataFrame, column: str, rows: int, allowed: Column | None = None) -> DataFrame:
    """At most ``rows`` labelled documents, those with the least hash of their id: ``doc_id``, ``text``, ``y``.

    Rows with a null id or label are left out, repeated labels give the larger
    one, of rows that share a doc_id the first text counts; null texts are empty.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    if allowed is not None:
        known = known.where(allowed)
    one = known.groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    picked = one.withColumn("_o", F.xxhash64("doc_id")).orderBy("_o", "doc_id").limit(rows).select("doc_id", "y")
    # The limit bounds what is broadcast.
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def sparse_rows(sample: DataFrame, features: Callable[[str], tuple[np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Features of the sample's texts, made by tasks, in doc_id order: indices, values, labels, ids. Bounded by the sample."""
    def made(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                at, x = features(batch.column(1)[i].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(2).slice(i, 1), pa.array([at.astype("<i4").tobytes()], pa.binary()),
                                                  pa.array([x.astype("<f4").tobytes()], pa.binary())], ["doc_id", "y", "i", "x"])

    got = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "y").mapInArrow(made, "doc_id long, y int, i binary, x binary").collect()
    got = sorted(got, key=lambda r: r["doc_id"])
    return ([np.frombuffer(r["i"], "<i4") for r in got], [np.frombuffer(r["x"], "<f4") for r in got],
            np.array([r["y"] for r in got], np.float64), np.array([r["doc_id"] for r in got], np.int64))


def fit(at: list[np.ndarray], x: list[np.ndarray], y: np.ndarray, size: int, factors: int = 0, epochs: int = 12, rate: float = 0.1,
        decay: float = 1e-5, batch: int = 128, seed: int = 7) -> Model:
    """Logistic loss by AdaGrad over shuffled batches; without rows the model scores 0."""
    rng = np.random.default_rng(seed)
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    bias, w = float(np.log(share / (1 - share))), np.zeros(size)
    v = rng.normal(0, 0.01, (factors, size))
    sum_b, sum_w, sum_v = 1e-8, np.full(size, 1e-8), np.full((factors, size), 1e-8)
    some = np.array([k for k in range(len(y)) if len(at[k])], np.int64)
    for _ in range(epochs):
        rng.shuffle(some)
        for low in range(0, len(some), batch):
            own = some[low:low + batch]
            i, value = np.concatenate([at[k] for k in own]), np.concatenate([x[k] for k in own]).astype(np.float64)
            n = np.array([len(at[k]) for k in own])
            starts, row = np.cumsum(n) - n, np.repeat(np.arange(len(own)), n)
            score = bias + np.add.reduceat(w[i] * value, starts)
            if factors:
                vx = v[:, i] * value
                total = np.add.reduceat(vx, starts, axis=1)
                score += 0.5 * (total**2 - np.add.reduceat(vx**2, starts, axis=1)).sum(axis=0)
            g = (probability(score) - y[own]) / len(own)
            gx = g[row] * value
            seen, place = np.unique(i, return_inverse=True)
            step = np.bincount(place, gx) + decay * w[seen]
            sum_w[seen] += step**2
            w[seen] -= rate * step / np.sqrt(sum_w[seen])
            for f in range(factors):
                step = np.bincount(place, gx * (total[f][row] - vx[f])) + decay * v[f][seen]
                sum_v[f][seen] += step**2
                v[f][seen] -= 0.2 * rate * step / np.sqrt(sum_v[f][seen])
            sum_b += g.sum() ** 2
            bias -= rate * g.sum() / np.sqrt(sum_b)
    return Model(float(bias), w.astype(np.float32), np.ascontiguousarray(v.T).astype(np.float32) if factors else None)


def calibrated(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that make ``slope * score + intercept`` the log odds (Platt's method, smoothed labels, Newton steps)."""
    ones, zeros = y.sum(), len(y) - y.sum()
    if not ones or not zeros:
        return 1.0, 0.0
    t = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a = np.array([1.0, 0.0])
    x = np.stack([scores, np.ones(len(scores))], 1)
    for _ in range(50):
        p = probability(x @ a)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        move = np.linalg.solve(h, x.T @ (p - t))
        a -= np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-8:
            break
    return float(max(a[0], 1e-3)), float(a[1])
