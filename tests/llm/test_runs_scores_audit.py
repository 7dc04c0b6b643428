"""Runs of words, lattice likelihood, filter audit: each against a brute-force version or SQL."""

import itertools
import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from placewatch.llm.audit import LETTERS, count_masks, document_stream, interactions
from placewatch.llm.lattice import Pieces, expected_uses, learn_lattice, score_documents, word_scores
from placewatch.llm.queries import op11_periodic_runs
from placewatch.llm.runs import extension, grammar, periodic_runs, runs_of

from .conftest import SF, SPACED

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def plain_runs(w, least=24, times=3):
    """Every stretch that a period allows, extended as far as it goes; the least period of each counts."""
    out = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i - s + p >= max(least, times * p):
                out.setdefault((s, i - s + p), p)
            i += 1
    return sorted((s, n, p) for (s, n), p in out.items())


def made_periodic(rng, n, letters):
    w = [rng.randrange(letters) for _ in range(n)]
    if n and rng.random() < .7:
        a = rng.randrange(n)
        p = 1 + (n - a) // (3 + rng.randrange(8))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize("seed", range(25))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    docs = [made_periodic(rng, rng.choice([0, 1, 23, 24, 75, 300]), rng.choice([1, 2, 3, 40])) for _ in range(rng.randint(1, 8))]
    least = rng.choice([3, 24])
    found = runs_of(np.array([x for w in docs for x in w], np.int64), np.array([len(w) for w in docs], np.int64), least, 3)
    got = list(zip(*[x.tolist() for x in found]))
    assert got == [(k, *r) for k, w in enumerate(docs) for r in plain_runs(w, least)]


def test_extensions_equal_brute_force():
    rng = random.Random(2)
    for letters in (1, 2, 5):
        words = [rng.randrange(letters) + 2 for _ in range(200)]
        row = np.array([0, *words, 1])
        pairs = [(i, j) for i in range(1, 200, 7) for j in range(i + 1, 201, 5)]
        a, b = (np.array(x) for x in zip(*pairs))
        want = [next(k for k in itertools.count() if row[i + k] != row[j + k]) for i, j in pairs]
        assert extension(grammar(row, 2), a, b).tolist() == want


def test_periodic_runs_of_odd_texts(spark, frame, odd):
    loop = "lead in " + "one two three four five " * 9 + "tail"
    rows = [*odd, (20, loop), (20, loop), (21, "x " * 500), (22, "A a " * 12), (23, "w " * 23)]
    out = periodic_runs(frame(rows)).collect()
    assert len(out) == len(rows) and "_words" in out[0].asDict()
    by = {}
    for r in out:
        words = SPACED.findall(r.text or "")
        runs = [tuple(x) for x in r._runs]
        assert runs == plain_runs(words) if len(words) < 2000 else True
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        assert r._collapsed == " ".join(w for k, w in enumerate(words) if k not in gone)
        by[r.doc_id] = runs
    assert by[20] == [(2, 45, 5)] and by[21] == [(0, 500, 1)] and by[22] == [(0, 24, 2)] and by[23] == []
    assert periodic_runs(frame([])).count() == 0
    with pytest.raises(ValueError, match="three periods"):
        periodic_runs(frame(odd), times=2)


def test_op11_has_a_row_per_document(spark):
    out = op11_periodic_runs(spark, SF)
    assert out.count() == 200 and out.where("n_runs > 0").count() > 20
    assert out.where("n_runs > 0 AND (start IS NULL OR exponent_milli < 3000) OR n_runs = 0 AND start IS NOT NULL OR runs_sha256 IS NULL").count() == 0


@pytest.fixture(scope="module")
def known():
    return Pieces(PIECES)


def pieces_of(known):
    found = {}

    def walk(at, before):
        if known.piece[at] >= 0:
            found[before] = int(known.piece[at])
        for b in np.flatnonzero(known.step[at]):
            walk(int(known.step[at, b]), before + bytes([b]))

    walk(0, b"")
    return found


def test_lattice_adds_up_all_segmentations(known):
    """Every way to cut a word, one by one."""
    names = pieces_of(known)
    weights = np.log(known.first)

    def ways(unit):
        if not unit:
            yield []
        for k in range(1, len(unit) + 1):
            own = [names[unit[:k]]] if unit[:k] in names else []
            for piece in own + ([unit[0]] if k == 1 else []):
                for rest in ways(unit[k:]):
                    yield [piece, *rest]

    words = [b"the", b"thanst", b"", b"x", "né".encode(), b"\x1c"]
    uses, want = np.zeros(known.size), []
    for w in words:
        found = list(ways(b" " + w))
        p = np.array([math.exp(sum(weights[k] for k in way)) for way in found])
        want.append(math.log(p.sum()))
        for way, share in zip(found, 3 * p / p.sum()):
            for k in way:
                uses[k] += share
    assert np.allclose(word_scores(known, weights, words), want, rtol=1e-12)
    assert np.allclose(expected_uses(known, weights, words, np.full(len(words), 3.0)), uses, atol=1e-9)


def test_a_very_long_word_does_not_underflow(known):
    got = word_scores(known, np.log(known.first), [b"q" * 20_000])
    assert np.isfinite(got).all() and got[0] < -10_000


def test_documents_are_scored_as_their_words(spark, frame, odd, known, monkeypatch):
    """Against sums over whole texts; frequent words, which are looked up, and the others, which are joined, agree."""
    docs = frame(odd)
    training = F.col("doc_id") % 2 == 1
    for share in (1 << 20, 2):      # all words are broadcast; next to none
        monkeypatch.setattr("placewatch.llm.lattice.FREQUENT", share)
        model = learn_lattice(docs, PIECES, training, rounds=2)
        tokens = [(t or "").encode().lower().split() for _, t in odd]
        train = [k for k, (i, _) in enumerate(odd) if i is not None and i % 2 == 1]
        counts = {}
        for k in train:
            for w in tokens[k]:
                counts[w] = counts.get(w, 0) + 1
        n, v = sum(counts.values()) + len(train), len(counts) + 1
        assert (model.tokens, model.distinct, model.documents) == (n, v, len(train))
        want = []
        for k, (i, _) in enumerate(odd):
            score = word_scores(known, model.weights, tokens[k]).sum() + model.weights[-1]
            base = sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in tokens[k]) + math.log10((len(train) + 1) / (n + v + 1))
            want.append((str(i), len(tokens[k]) + 1, sum(w in counts for w in tokens[k]) + 1, base, score / math.log(10)))
        got = sorted((str(r.doc_id), r._tokens, r._known, r._base, r._score) for r in score_documents(docs, model).collect())
        for a, b in zip(got, sorted(want), strict=True):
            assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-9)
    assert abs(np.exp(model.weights).sum() - 1) < 1e-9


def test_scoring_without_rows_or_training(spark, frame):
    model = learn_lattice(frame([]), PIECES, F.lit(True), rounds=1)
    assert model.tokens == 0 and score_documents(frame([]), model).count() == 0
    docs = frame([(1, "one two"), (2, None)])
    got = {r.doc_id: r for r in score_documents(docs, learn_lattice(docs, PIECES, F.lit(False))).collect()}
    assert got[1]._known == 0 and got[1]._score < got[2]._score < 0


def test_more_rounds_fit_held_out_texts_better(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    training = F.col("doc_id") % 3 != 0
    totals = [score_documents(docs, learn_lattice(docs, PIECES, training, rounds=r)).where("doc_id % 3 = 0").agg(F.sum("_score")).first()[0] for r in (0, 4)]
    assert totals[1] > totals[0]


def plain_audit(rows, labels):
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    facts = []
    for i, text, source in rows:
        t = text or ""
        w = SPACED.findall(t)
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
                 any(c in "#$%&*|" for c in t), i is not None and i > least[t]]
        facts.append((source or "", {x for x, f in zip(LETTERS, fails) if f}, *labels.get(i, (0, 0))))
    out = {}
    orders = list(itertools.permutations(LETTERS))
    for part in {f[0] for f in facts}:
        own, removed = [f for f in facts if f[0] == part], dict.fromkeys(LETTERS, 0)
        for order in orders:
            for step, x in enumerate(order, 1):
                before = set(order[:step - 1])
                here = [f for f in own if x in f[1] and not f[1] & before]
                removed[x] += len(here)
                out[part, "".join(order), step] = [sum(not f[1] & {*before, x} for f in own), len(here), sum(x in f[1] and bool(f[1] & before) for f in own),
                                                   sum(f[1] == {x} for f in own), sum(f[2] for f in here), sum(f[3] for f in here)]
        for order in orders:
            for step, x in enumerate(order, 1):
                out[part, "".join(order), step].append(removed[x])
    return out


def test_audit_with_retractions(spark, prose, folder):
    """Smaller ids arrive in later files, and later runs; the counters are those of one pass over all rows."""
    a, b = prose(80, 1), "SHOUT " * 60
    files = [[(50, a, "s"), (51, a, "s"), (7, b, None), (None, a, "s"), (None, None, None)],
             [(40, a, "t"), (40, a, "s"), (60, b, ""), (8, "short #", "t"), (9, None, "t"), (9, "", "s")],
             [(41, a, "t"), (3, b, "s"), (3, b, "s"), (39, a, None), (70, prose(400, 3), "t"), (71, prose(30, 4), "s")]]
    labels = {40: (1, 0), 39: (0, 1), 7: (1, 1), 60: (1, 0), 8: (0, 1)}
    known = spark.createDataFrame([(40, 1, 0), (40, 0, None), (39, 0, 1), (7, 1, 1), (60, 1, 0), (8, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = []
    for n, own in enumerate(files):
        # The first two files arrive before the first run, in a micro-batch each.
        spark.createDataFrame([(*r, 1) for r in own], "doc_id long, text string, source string, mask int").coalesce(1).write.mode("append").parquet(folder + "/docs")
        rows += own
        if n:
            got = interactions(count_masks(document_stream(spark, folder + "/docs"), known, folder + "/audit")).collect()
            assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == plain_audit(rows, labels)
    again = interactions(count_masks(document_stream(spark, folder + "/docs"), known, folder + "/audit"))
    assert again.count() == 600 * len({r[2] or "" for r in rows})
    moves = spark.read.parquet(folder + "/audit/moves")
    assert moves.where("NOT _new").count() > 0      # something was retracted


def test_audit_of_an_empty_table(spark, folder):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(folder + "/docs")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions(count_masks(document_stream(spark, folder + "/docs"), labels, folder + "/audit")).count() == 0
