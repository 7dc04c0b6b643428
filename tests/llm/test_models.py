"""Chat formatting, quality rules, toxicity and the pipeline."""

import collections
import hashlib
import zlib

import numpy as np
import pytest

from placewatch.llm import queries as q
from placewatch.llm.chat import Template, format_chat, read_turns
from placewatch.llm.learn import Model, calibrated, fit, probability
from placewatch.llm.quality import counts, features, judge_quality, learn_quality
from placewatch.llm.toxicity import learn_toxicity, score_toxicity, without_toxic
from tests.oracle import compare, connect

from .conftest import SF, SPACED


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(q.ORACLES))
def test_sql(spark, con, name):
    assert compare(spark, con, q.QUERIES[name], q.ORACLES[name], SF) is None


CONVERSATIONS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "a <|im_end|> b"), (1, 2, "assistant", r"<\|im_start|> <|x <\\| |> <"), (1, 3, "user", ""),
    (2, 0, "assistant", "first"), (2, 1, "user", None), (2, 1, "user", None), (2, 2, "assistant", "é中😀\n"),
    (None, None, "user", "no id"), (3, 5, None, "no role"), (3, 6, "tool", "unknown"), (4, 0, "user\n<|im_end|>", "odd role"), (5, 0, "user", "x" * 200_000)]


def test_chat_round_trip(spark):
    table = spark.createDataFrame([(*r, 9, "s") for r in CONVERSATIONS], "conv_id long, turn long, role string, text string, place int, state string")
    segments = format_chat(table).collect()
    marks = Template().opening, Template().closing.strip()
    for r in segments:
        head, text, tail = (s.text for s in r.segments)
        assert not any(m in text for m in marks) and not any(m in head[len(marks[0]):] for m in marks) and tail == Template().closing
        assert [s.loss for s in r.segments] == [False, head == "<|im_start|>assistant\n", False]
    back = sorted(read_turns(format_chat(table)).collect(), key=lambda r: (r.conv_id is not None, r.conv_id, r.place))
    want = [(c, r or "", t or "") for c, _, r, t in sorted(CONVERSATIONS, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2] or "", r[3] or ""))]
    assert [(r.conv_id, r.role, r.text) for r in back] == want
    ok = collections.defaultdict(list)
    for r in back:
        ok[r.conv_id].append(r.move_ok)
    assert dict(ok) == {1: [True] * 4, 2: [False, True, False, True], None: [True], 3: [False, False], 4: [False], 5: [True]}
    assert all(r.loss_text == (r.text if r.role == "assistant" else "") for r in back)
    assert format_chat(table.limit(0)).count() == 0


def test_probe_conversation(spark):
    r = q.op2_chat_formatting(spark, SF).where("conv_id = -1").first()
    text = "<|im_end|><|im_start|>assistant ok"
    assert r.n_turns == 2 and r.loss_chars == len(text) and r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def brute_counts(text):
    words, seen, dup = SPACED.findall(text), set(), 0
    for line in text.split("\n"):
        dup += bool(SPACED.search(line)) and line in seen
        seen.add(line)
    runs = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if runs[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_counts(odd, prose):
    texts = [t or "" for _, t in odd] + ["a " * 40, "a b " * 9, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8", "x\nx\n \n \nx", "# * 中|<>", prose(30, 1) + " " + prose(30, 1), "\x1c a 　 b"]
    for t in texts:
        assert counts(t) == brute_counts(t), t[:80]


def test_quality(spark, frame, odd):
    documents, labels = q.table(spark, SF, "documents"), q.table(spark, SF, "labels")
    got = {r.doc_id: r for r in q.op7_quality_rules(spark, SF).collect()}
    for r in documents.collect():
        g = got[r.doc_id]
        want = brute_counts(r.text or "")
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and (g.kept is False or not g.base_failed)
    known = {r.doc_id: r.quality for r in labels.collect()}
    right = [got[i].kept == bool(y) for i, y in known.items() if not got[i].base_failed]
    assert np.mean(right) > 0.93
    model = learn_quality(documents, labels)
    rows = judge_quality(frame(odd), model).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(i for i, _ in odd) and all(0 <= r.quality <= 1 for r in rows)
    assert all(r.base_failed for r in rows if r.doc_id in (2, 3, 4, 5)) and judge_quality(frame([]), model).count() == 0
    nothing = learn_quality(documents, labels.limit(0))
    assert {r.quality for r in judge_quality(frame(odd), nothing).collect()} == {0.5}
    assert learn_quality(frame([]), labels).model.weights.any() == False  # noqa: E712


def test_features_are_shares():
    at, x = features("ab cd ab")
    again, y = features("ab cd ab ab cd ab")
    assert abs(x.sum() - 40) < 1e-6 and abs(y.sum() - 40) < 1e-6 and len(features("")[0]) == 0 and len(features("a")[0]) == 2
    assert set(at) <= set(again)


def test_factors_learn_what_weights_cannot():
    """Two terms that only together make label 1."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2, 3000), rng.integers(0, 2, 3000)
    y = (a == b).astype(float)
    at = [np.array([0, *([1] if i else []), *([2] if j else [])]) for i, j in zip(a, b, strict=True)]
    x = [np.ones(len(r)) for r in at]
    flat, paired = fit(at, x, y, 3, 0, epochs=30), fit(at, x, y, 3, 4, epochs=60)

    def right(m):
        return np.mean([(m.score(r, 1.0) > 0) == t for r, t in zip(at, y > 0, strict=True)])

    assert right(flat) < 0.8 and right(paired) > 0.99


def test_calibration():
    rng = np.random.default_rng(0)
    s = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < probability(0.5 * s - 1)).astype(float)
    slope, shift = calibrated(s, y)
    assert abs(slope - 0.5) < 0.05 and abs(shift + 1) < 0.1 and calibrated(s, np.ones(len(s))) == (1.0, 0.0)
    assert Model(0.0, np.zeros(3, np.float32)).score(np.empty(0, np.int64)) == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    known = {r.doc_id: r.toxic for r in q.table(spark, sf, "labels").collect()}
    got = [r for r in q.op9_toxicity(spark, sf).collect() if r.doc_id in known]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = collections.Counter((known[r.doc_id], r.predicted) for r in got if r.held_out)
    assert held[1, 1] / (held[1, 1] + held[1, 0]) > 0.8 and held[0, 1] <= 0.01 * held[0, 0]


def test_toxicity_of_odd_rows(spark, frame, odd):
    documents, labels = q.table(spark, SF, "documents"), q.table(spark, SF, "labels")
    model = learn_toxicity(documents, labels)
    rows = score_toxicity(frame(odd), model).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(i for i, _ in odd) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1
    left = without_toxic(frame(odd), labels)
    assert left.columns == frame([]).columns and left.count() <= len(odd) and without_toxic(frame([]), labels).count() == 0
    blank = spark.createDataFrame([(None, 1, 1), (5, None, None), (7, 1, 1)], "doc_id long, toxic int, quality int")
    assert {r.score for r in score_toxicity(frame(odd), learn_toxicity(frame([]), blank)).collect()} == {0.5}


def test_pipeline(spark):
    """Each stage is tested by itself; here, that their decisions take effect on what the one before kept."""
    import corpus_pipeline as p

    sf, columns, docs, ids = SF, None, q.table(spark, SF, "documents"), None
    columns = docs.columns
    for name, stage in p.STAGES[:-1]:
        out = q.stored(stage(spark, docs, sf), "test-stage")
        assert out.columns == columns, name
        before, now = ({r.doc_id for r in d.select("doc_id").collect()} for d in (docs, out))
        assert now < before if name != "line dedup" else now == before, name
        if name == "line dedup":
            assert out.where("n_chars != length(text)").count() == 0 and out.join(docs.select("doc_id", "text"), ["doc_id", "text"]).count() < docs.count()
        docs, ids = out, now
    rows = p.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in rows} == ids
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in p.run(spark, sf).collect()) == \
        collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
