"""Likelihood of texts under a unigram model of subword pieces, over all ways to cut them.

The pieces and their first weights come from an existing vocabulary; what is
learned is how often each piece is used. A word is a mark (written as a space)
and its bytes, and every way to cut it into pieces is a path through a lattice:
the forward recursion in log space adds up the paths, so a word's probability
is the sum over all its segmentations and not that of the best one. No piece
crosses the start of a word and every text ends with an end symbol, so a
document's marginal probability is the product over its words and the end.
Single bytes are pieces too, so that no text has probability zero.

Learning counts each training word once with its number of occurrences and
adds expected uses of pieces (forward times backward) over tasks; only the
vector of pieces, bounded by the vocabulary, meets on the driver. Scoring looks
frequent words up in a table of bounded size, and joins the others by word.
"""

from __future__ import annotations

import dataclasses
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import per_process, stored

#: Words met at least once in this many tokens are broadcast: there cannot be more of them.
FREQUENT = 1 << 20
#: Longer words are never broadcast.
LONGEST = 64
#: Distinct words a task holds before it passes its counts on.
HELD = 1 << 18
#: Words of a lattice pass worked on together.
TOGETHER = 1 << 15
#: Mark of a word's start inside vocabulary files.
MARK = "▁"


class Pieces:
    """The pieces of a vocabulary as a trie over bytes: ``step[state, byte]`` is the next state or 0, ``piece[state]`` a piece or -1.

    Numbers 0 to 255 are single bytes, the number after the last piece is the end symbol.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        known, rank = {}, []
        for i in range(model.get_piece_size()):
            if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            text = model.id_to_piece(i)
            own = text.replace(MARK, " ", 1).encode() if text.startswith(MARK) else text.encode()
            # A mark inside a piece or a capital letter never meets a word.
            if MARK in text[1:] or own != own.lower() or own in known:
                continue
            known[own] = 256 + len(rank)
            rank.append(-model.get_score(i))
        self.size = 257 + len(rank)
        #: Scores are ranks of frequency, which fall off as one over the rank; bytes and the end weigh as the last one.
        first = np.concatenate([np.full(256, 1 / (2 + max(rank, default=0))), 1 / (2 + np.array(rank)), [1 / (2 + max(rank, default=0))]])
        self.first = first / first.sum()
        step, piece = [defaultdict(int)], [-1]
        for own, number in known.items():
            at = 0
            for b in own:
                if not step[at][b]:
                    step[at][b] = len(step)
                    step.append(defaultdict(int))
                    piece.append(-1)
                at = step[at][b]
            piece[at] = number
        self.step = np.zeros((len(step), 256), np.int32)
        for at, after in enumerate(step):
            for b, to in after.items():
                self.step[at, b] = to
        self.piece = np.array(piece, np.int32)


def pieces(path: str) -> Pieces:
    """The pieces of this Python worker."""
    return per_process(f"pieces {path}", lambda: Pieces(path))


def _equal_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and bytes of words of the same length, a mark before each."""
    length = np.array([len(w) for w in words], np.int64)
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order])) + 1
    for own in np.split(order, cuts) if len(words) else ():
        n = int(length[own[0]]) + 1
        yield own, np.frombuffer(b"".join([b" " + words[k] for k in own]), np.uint8).reshape(len(own), n)


def _arcs(known: Pieces, units: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, rows, pieces) of the lattice of each row, by rising start."""
    rows, n = units.shape
    every = np.arange(rows)
    for i in range(n):
        yield i, i + 1, every, units[:, i].astype(np.int64)
        live, at = every, np.zeros(rows, np.int32)
        for j in range(i, n):
            at = known.step[at, units[live, j]]
            going = at > 0
            if not going.all():
                live, at = live[going], at[going]
            if not len(live):
                break
            piece = known.piece[at]
            there = piece >= 0
            if there.any():
                yield i, j + 1, live[there], piece[there]


def word_scores(known: Pieces, weights: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Natural logarithm of each word's marginal probability; ``weights`` are logarithms by piece."""
    out = np.zeros(len(words))
    for own, units in _equal_length(words):
        ahead = np.full((units.shape[1] + 1, len(own)), -np.inf)
        ahead[0] = 0
        for i, j, rows, piece in _arcs(known, units):
            ahead[j, rows] = np.logaddexp(ahead[j, rows], ahead[i, rows] + weights[piece])
        out[own] = ahead[-1]
    return out


def expected_uses(known: Pieces, weights: np.ndarray, words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """How often each piece is used on average over all segmentations of the words, each ``counts`` times."""
    uses = np.zeros(known.size)
    for own, units in _equal_length(words):
        arcs = list(_arcs(known, units))
        ahead = np.full((units.shape[1] + 1, len(own)), -np.inf)
        ahead[0] = 0
        for i, j, rows, piece in arcs:
            ahead[j, rows] = np.logaddexp(ahead[j, rows], ahead[i, rows] + weights[piece])
        behind = np.full_like(ahead, -np.inf)
        behind[-1] = 0
        for i, j, rows, piece in reversed(arcs):
            through = behind[j, rows] + weights[piece]
            behind[i, rows] = np.logaddexp(behind[i, rows], through)
            uses += np.bincount(piece, counts[own[rows]] * np.exp(ahead[i, rows] + through - ahead[-1, rows]), known.size)
    return uses


def count_words(documents: DataFrame, training: Column) -> DataFrame:
    """``word`` (bytes), ``c`` (occurrences in training documents), ``n`` (in all)."""
    def work(batches):
        import pyarrow as pa

        learned, other = Counter(), Counter()

        def out():
            both = learned + other if learned and other else learned or other
            yield pa.RecordBatch.from_arrays([pa.array(list(both), pa.binary()), pa.array([learned[w] for w in both], pa.int64()),
                                              pa.array(list(both.values()), pa.int64())], ["word", "c", "n"])
            learned.clear()
            other.clear()

        for batch in batches:
            for text, train in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                (learned if train else other).update(text.lower().split())
                if len(learned) + len(other) > HELD:
                    yield from out()
        yield from out()

    rows = documents.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    return rows.mapInArrow(work, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def _in_lots(batches, columns: int) -> Iterator[list[list]]:
    """Columns of Arrow batches as lists of at least TOGETHER rows, the last one shorter."""
    lots = [[] for _ in range(columns)]
    for batch in batches:
        for lot, column in zip(lots, batch.columns):
            lot.extend(column.to_pylist())
        if len(lots[0]) >= TOGETHER:
            yield lots
            lots = [[] for _ in range(columns)]
    if lots[0]:
        yield lots


@dataclasses.dataclass
class LatticeModel:
    """Logarithms of piece weights, the words counted for it, and the figures of the training tokens."""

    path: str
    weights: np.ndarray
    words: DataFrame           # word, c, n, score (natural logarithm)
    tokens: int                # training tokens, ends included
    distinct: int
    documents: int
    all_words: int


def learn_lattice(documents: DataFrame, path: str, training: Column, rounds: int = 4, prior: float = 1.0) -> LatticeModel:
    """Learn the uses of the vocabulary's pieces from the documents where ``training`` is true.

    ``rounds`` of expectation maximisation start from the vocabulary's own
    scores, which also smooth each round with ``prior`` uses per piece in all.
    All training words count, whatever their number. A null text is empty;
    without training documents the vocabulary's scores are the model.
    """
    known = pieces(path)
    words = stored(count_words(documents, training), "lattice-words")
    sums = words.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1)), F.sum("n")).first()
    ends = documents.where(F.coalesce(training, F.lit(False))).count()
    weights = np.log(known.first)
    for _ in range(rounds):
        now = weights

        def work(batches, now=now):
            import pyarrow as pa

            own, uses = pieces(path), 0
            for word, c in _in_lots(batches, 2):
                uses = uses + expected_uses(own, now, word, np.array(c, np.float64))
            at = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.atleast_1d(uses)[at], pa.float64())], ["piece", "uses"])

        rows = words.where("c > 0").select("word", "c").mapInArrow(work, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        uses = np.zeros(known.size)
        for r in rows:                                  # at most one row per piece
            uses[r.piece] = r.uses
        uses[-1] = ends
        mass = uses + prior * known.size * known.first
        weights = np.log(mass / mass.sum())

    def score(batches):
        import pyarrow as pa

        own = pieces(path)
        for word, c, n in _in_lots(batches, 3):
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.binary()), pa.array(c, pa.int64()), pa.array(n, pa.int64()),
                                              pa.array(word_scores(own, weights, word))], ["word", "c", "n", "score"])

    scored = stored(words.select("word", "c", "n").mapInArrow(score, "word binary, c long, n long, score double"), "lattice-scores")
    return LatticeModel(path, weights, scored, (sums[0] or 0) + ends, sums[1] + (ends > 0), ends, sums[2] or 0)


def score_documents(documents: DataFrame, model: LatticeModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row, with ``_tokens``, ``_known`` (tokens met in training), ``_base`` and ``_score``.

    ``_score`` is the base-10 logarithm of the text's probability over all
    segmentations, ``_base`` that of a unigram model of whole words with one
    added to each count. Words are split at the white space characters 9 to 13
    and 32, with A to Z lower-cased; the end of a text is a token. Null and
    empty texts have the end only. Rows are scored one by one: repeated rows,
    null ids and other columns make no difference; an empty table gives an
    empty one. ``documents`` must be among those that the model was given,
    training or not; a word that it has not counted is an error.
    """
    spark = documents.sparkSession
    frequent = model.words.where((F.col("n") >= max(model.all_words / FREQUENT, 1)) & (F.octet_length("word") <= LONGEST))
    table = frequent.select("word", "c", "score").toArrow()
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, table.column(0).to_pylist(), table.column(1).to_numpy(), table.column(2).to_numpy()))
    log_all, ten = float(np.log10(model.tokens + model.distinct + 1)), float(np.log(10))

    def work(batches):
        import pyarrow as pa

        # The table of an earlier model in this worker is let go.
        held, name = per_process("lattice words", dict), shared.value[0]
        if name not in held:
            held.clear()
            _, words, c, score = shared.value
            held[name] = dict(zip(words, zip((c > 0).tolist(), (np.log10(c + 1.0) - log_all).tolist(), (score / ten).tolist())))
        get = held[name].get
        for batch in batches:
            sums, words, times, ends = [], [], [], [0]
            for text in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist():
                found = text.lower().split()
                known, base, total = 0, 0.0, 0.0
                for word, k in Counter(found).items():
                    own = get(word)
                    if own is None:
                        words.append(word)
                        times.append(k)
                    else:
                        known += k * own[0]
                        base += k * own[1]
                        total += k * own[2]
                ends.append(len(words))
                sums.append((len(found) + 1, known, base, total))
            columns = [pa.array([x[k] for x in sums], pa.float64() if k > 1 else pa.int64()) for k in range(4)]
            rest = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int64())], ["word", "k"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)],
                                             ["_id", *names, "_tokens", "_known", "_base", "_score", "_rest"])

    # Kept columns go by number inside, so that their names can't clash.
    names = [f"c{i}" for i in range(len(keep))]
    rows = documents.select(F.monotonically_increasing_id().alias("_id"), *[F.col(c).alias(n) for c, n in zip(keep, names)],
                            F.coalesce("text", F.lit("")).alias("_text"))
    schema = T.StructType(rows.schema.fields[:-1])
    for c, kind in (("_tokens", "long"), ("_known", "long"), ("_base", "double"), ("_score", "double")):
        schema = schema.add(c, kind)
    schema = schema.add("_rest", T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("k", T.LongType())])))
    rows = stored(rows.mapInArrow(work, schema), "lattice-rows")
    rare = rows.where(F.size("_rest") > 0).select("_id", F.inline("_rest")).join(model.words.select("word", "c", "score"), "word", "left")
    log_c = F.log10(F.col("c") + 1) - log_all
    score = F.coalesce("score", F.raise_error(F.lit("a word that the model has not counted")).cast("double")) / ten
    rare = rare.groupBy("_id").agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("known"),
                                   F.sum(F.col("k") * log_c).alias("base"), F.sum(F.col("k") * score).alias("score"))
    end_base = float(np.log10(model.documents + 1)) - log_all
    end_score = float(model.weights[-1]) / ten
    return rows.drop("_rest").join(rare, "_id", "left").select(
        *[F.col(n).alias(c) for c, n in zip(keep, names)], "_tokens",
        (F.col("_known") + F.coalesce("known", F.lit(0)) + int(model.documents > 0)).alias("_known"),
        (F.col("_base") + F.coalesce("base", F.lit(0.0)) + end_base).alias("_base"),
        (F.col("_score") + F.coalesce("score", F.lit(0.0)) + end_score).alias("_score"))
