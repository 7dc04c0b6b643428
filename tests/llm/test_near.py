"""Near-duplicates, decontamination, line and substring dedup against brute force."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from placewatch.llm import common, components as stars, decontam, lines as passages, simhash as prints
from placewatch.llm.chunks import boundaries, dedup_substrings, repeated_passages
from placewatch.llm.components import components
from placewatch.llm.decontam import contaminated, without_contaminated
from placewatch.llm.lines import dedup_lines
from placewatch.llm.simhash import fingerprint, linked, near_duplicates, one_of_each, similar

from .conftest import SPACED, links


def words_of(text):
    return SPACED.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, k):
    w = words_of(text)
    return [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def simhash(text, k=4):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, k)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def edited(text, n, seed):
    rng, w = random.Random(seed), text.split(" ")
    for i in rng.sample(range(len(w)), n):
        w[i] += "rsfk"
    return " ".join(w)


@pytest.fixture(scope="module")
def copies(prose):
    """Groups of near copies with few and many edits, beside documents of their own."""
    out = []
    for g in range(12):
        base = prose(150 + 40 * g, 100 + g)
        out += [(1000 + 20 * g, base)] + [(1000 + 20 * g + k, edited(base, k, k)) for k in range(1, 9)]
    out += [(5000 + i, prose(80, 900 + i)) for i in range(60)] + [(6000 + i, prose(9, 7)) for i in range(5)]
    return [(i, t.replace(" ", "\n", 1)) for i, t in out]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(3, 2), (2, 1), (5, 4)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 150)] + [(200, 149)]])
def test_components(spark, edges):
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = links({x for e in edges for x in e}, edges)
    assert {(r.node, r.root) for r in got} == {(i, r) for i, r in want.items() if any(i in e and e[0] != e[1] for e in edges)} and len(got) == len({r.node for r in got})


def test_fingerprint_of_many_hashes():
    h = np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64)
    want = sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > 1000)
    assert fingerprint(h) % 2**64 == want
    assert fingerprint(np.full(2, 2**64 - 1, np.uint64)) == -1 and fingerprint(np.array([0, 1], np.uint64)) == 0  # half is not over half


def test_links_of_fingerprints_within_the_radius(spark):
    """Dense groups: many fingerprints around few centres, more than one key has to bridge them."""
    rng = random.Random(4)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(120):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    for radius, segments in ((4, 2), (5, 2), (8, 3)):
        nodes = spark.createDataFrame([(i, x - 2**64 if x >= 2**63 else x) for i, x in enumerate(fps)], "node long, fp long")
        got = {r.node: r.root for r in linked(nodes, radius, segments).collect()}
        pairs = [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= radius]
        want = links(range(len(fps)), pairs)
        assert {i: got.get(i, i) for i in want} == want
    with pytest.raises(ValueError):
        linked(nodes, 9, 3).count()


def test_near_duplicates(frame, odd, copies):
    rows = odd + copies
    got = near_duplicates(frame(rows)).collect()
    assert len(got) == len(rows)
    fps = {t: simhash(t) for _, t in rows}
    assert collections.Counter((r.doc_id, r.fingerprint) for r in got) == collections.Counter((i, f"{fps[t]:016x}") for i, t in rows)
    # Documents by place, so that null and repeated ids take part.
    near = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (fps[rows[a][1]] ^ fps[rows[b][1]]).bit_count() <= 4]
    root = links(range(len(rows)), near)
    least = collections.defaultdict(list)
    for p, (i, _) in enumerate(rows):
        least[root[p]].append(i)
    want = collections.Counter((i, f"{fps[t]:016x}", min((x for x in least[root[p]] if x is not None), default=None)) for p, (i, t) in enumerate(rows))
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert near_duplicates(frame([])).count() == 0
    only_null = near_duplicates(frame([(None, "a b")])).collect()
    assert [(r.doc_id, r.component_id) for r in only_null] == [(None, None)]


def test_one_of_each(frame, odd, copies):
    rows = [(i, t) for i, t in odd if i not in (1, 8)] + copies
    got = one_of_each(frame(rows))
    assert got.columns == frame([]).columns
    named = [(i, t) for i, t in rows if i is not None]
    sets = {i: set(shingles(t, 5)) for i, t in named}

    def alike(a, b):
        both = len(a & b)
        return both >= 0.8 * (len(a) + len(b) - both)

    root = links(sets, [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if alike(sets[a], sets[b])])
    want = collections.Counter([i for i in sets if root[i] == i] + [i for i, _ in rows if i is None])
    assert collections.Counter(r.doc_id for r in got.collect()) == want
    # Repeated rows are one document.
    again = one_of_each(frame([(1, "a b c"), (1, "a b c"), (2, "x y z"), (2, "p q r")])).collect()
    assert sorted(r.doc_id for r in again) == [1, 2, 2]
    assert one_of_each(frame([])).count() == 0


@pytest.fixture
def planned(monkeypatch):
    """Plans of all tables that the operators write, by name; nothing counts as few."""
    found = collections.defaultdict(list)

    def kept(df, name, *a, write=common.stored):
        found[name].append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name, *a)

    for module in (prints, stars, passages, decontam):
        monkeypatch.setattr(module, "stored", kept)
    monkeypatch.setattr(common, "FEW", 0, raising=False)
    return found


def test_sides_that_grow_with_the_documents_are_not_broadcast(frame, copies, planned):
    docs = frame(copies)
    for out in (near_duplicates(docs, radius=4), one_of_each(docs)):
        planned["out"].append(out._jdf.queryExecution().executedPlan().toString())
    assert {"near", "edges", "links", "blobs", "shingles", "first-shingles", "pairs", "pair-shingles"} <= set(planned)
    assert not [name for name, plans in planned.items() for p in plans if "BroadcastExchange" in p]


def test_repeated_lines_are_not_broadcast(frame, prose, planned):
    docs = frame([(i, prose(60, 1, 6) + f"\n{prose(20, 50 + i, 5)}") for i in range(20)])
    out = dedup_lines(docs, passages=True)
    # The maps of fixed size are the only sides that travel through the driver.
    texts = [*planned["first-pairs"], out._jdf.queryExecution().executedPlan().toString()]
    assert all(p.count("BroadcastHashJoin") <= 1 for p in texts) and sum(r.text is not None for r in out.collect()) == 20


def test_keys_of_many_items_are_not_broadcast(spark, frame, prose, planned):
    items = spark.createDataFrame([(i, prose(30, 70 + i)) for i in range(5)], "item_id long, text string")
    out = contaminated(frame([(i, prose(30, 70 + i)) for i in range(3)]), items)
    assert sorted((r.doc_id, r.item_id) for r in out.collect()) == [(i, i) for i in range(3)]
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_one_of_each_with_clashing_ids(frame, prose):
    """Different texts under one doc_id are documents of their own; of alike ones the smallest doc_id stays, then the least digest."""
    a, b, c = (prose(80, 5000 + i) for i in range(3))
    rows = [(1, a), (1, b), (1, b), (2, b + " end"), (3, c), (3, c + " end"), (4, None), (4, a + " x"), (5, "p q r"), (5, "x y z w"), (6, "P Q R")]
    got = sorted((r.doc_id, r.text or "") for r in one_of_each(frame(rows)).collect())
    one_c = min(c, c + " end", key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert got == sorted([(1, a), (1, b), (3, one_c), (4, ""), (5, "p q r"), (5, "x y z w")])


def test_one_of_each_with_appended_blocks(frame, prose):
    """Copies with a block of other text before or behind, just over the similarity: fingerprints miss many, none may be."""
    rows, far = [], 0
    for g in range(60):
        base = prose(100 + 7 * g, 3000 + g)
        block = prose(int((100 + 7 * g) * (0.12 + 0.1 * (g % 5) / 4)), 4000 + g)
        rows += [(10 * g, base), (10 * g + 1, f"{base} {block}" if g % 2 else f"{block} {base}")]
        far += (simhash_of_words(rows[-1][1]) ^ simhash_of_words(base)).bit_count() > 8
    sets = {i: set(shingles(t, 5)) for i, t in rows}
    want = sorted(i for i in sets if i % 10 == 0 or len(sets[i] & sets[i - 1]) < 0.8 * len(sets[i] | sets[i - 1]))
    got = sorted(r.doc_id for r in one_of_each(frame(rows)).collect())
    assert far > 10 and len(want) < 75 and got == want


def simhash_of_words(text):
    return simhash(" ".join(sorted(set(words_of(text)))), 1)


@pytest.mark.parametrize(("most", "most_values"), [(1000, 10**6), (7, 10**6), (1000, 300)])
def test_similar_sets(spark, most, most_values):
    """Blocks of any size give the same components, with no more edges than a block has nodes."""
    rng = random.Random(8)
    sets = []
    for g in range(6):
        base = [rng.getrandbits(62) for _ in range(40)]
        for k in range(15):
            kept = rng.sample(base, 40 - rng.randint(0, 9))
            sets.append((g, sorted(kept + [rng.getrandbits(62) for _ in range(rng.randint(0, 3))])))
    sets += [(7, []), (7, []), (7, [5])]
    blobs = spark.createDataFrame([(i, g) for i, (g, _) in enumerate(sets)], "node long, root long")
    got = similar(blobs, spark.createDataFrame([(i, s) for i, (_, s) in enumerate(sets)], "node long, s array<long>"), 0.8, most, most_values).collect()
    near = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a][0] == sets[b][0]
            and len(set(sets[a][1]) & set(sets[b][1])) >= 0.8 * len(set(sets[a][1]) | set(sets[b][1]))]
    assert links(range(len(sets)), [(r.a, r.b) for r in got]) == links(range(len(sets)), near)
    assert most < 1000 or most_values < 10**6 or len(got) < len(sets)


def best_windows(docs, items, words=5, similarity=0.8):
    out = {}
    for (d, text), (i, item) in itertools.product(docs, items):
        a, b = ([tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))] if (w := SPACED.findall((t or "").lower())) else [] for t in (text, item))
        if not a or not b:
            continue
        n = min(len(a), len(b))
        count = collections.Counter(b)
        for p in range(len(a) - n + 1):
            both = sum((collections.Counter(a[p:p + n]) & count).values())
            s = both / (n + len(b) - both)
            if s >= similarity - 1e-9 and s > out.get((d, i), (0,))[0]:
                out[d, i] = (s, p, n)
    return {k: (round(s, 6), p, n) for k, (s, p, n) in out.items()}


@pytest.fixture(scope="module")
def leaks(prose):
    items = [(0, prose(30, 1)), (1, prose(18, 2)), (2, prose(30, 1).upper()), (3, "so it is"), (4, " ".join(["ha ho"] * 12)), (None, prose(25, 3)), (6, None), (7, "")]
    docs = [(i, prose(120, 50 + i)) for i in range(30)]
    docs += [(100, f"{prose(50, 90)}\n{items[0][1]} {prose(20, 91)}"), (101, items[1][1]), (102, prose(40, 92) + " " + edited(items[0][1], 1, 3)),
             (103, f"{items[1][1]} {prose(9, 93)} {items[1][1]} {items[5][1]}"), (104, "So\tit is"), (105, "ha ho " * 40), (106, edited(items[0][1], 6, 4)),
             (107, items[0][1].replace(" ", " x ", 1)), (108, " ".join(items[0][1].split()[:27])), (109, "so it was")]
    return docs, items


@pytest.mark.parametrize("broadcast_rows", [200_000, 40])
def test_contaminated(spark, frame, odd, leaks, broadcast_rows):
    docs, items = leaks
    rows = [(i + 200 if i is not None else None, t) for i, t in odd] + docs
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, fp int, m int")
    got = contaminated(frame(rows), table, broadcast_rows=broadcast_rows).collect()
    want = best_windows(rows, items)
    assert {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_runs) for r in got} == want and len(got) == len(want)
    assert {(100, 0), (100, 2), (101, 1), (103, None), (104, 3), (105, 4)} <= set(want)
    left = without_contaminated(frame(rows), table)
    assert left.columns == frame([]).columns
    assert collections.Counter(r.doc_id for r in left.collect()) == collections.Counter(i for i, _ in rows if i not in {d for d, _ in want})


def test_contaminated_by_nothing(spark, frame, leaks):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(frame(leaks[0]), none).count() == 0 and without_contaminated(frame(leaks[0]), none).count() == len(leaks[0])
    assert contaminated(frame([]), spark.createDataFrame(leaks[1], "item_id long, text string")).count() == 0


@pytest.fixture(scope="module")
def shared_lines(prose):
    passage, other = prose(90, 11, 9), prose(60, 12, 6)
    rows = [(10, f"{prose(40, 13, 8)}\n{passage}\n{prose(24, 14, 8)}"), (11, f"{prose(16, 15, 8)}\n{passage}"), (12, f"{other}\n{passage}\n{prose(9, 16)}"),
            (13, other), (14, passage), (15, "same line here\n" * 30), (16, "x\n\n\n\ny"), (17, "\n\n\n\n"), (18, prose(70, 17, 7))]
    return [*rows, (20, prose(40, 13, 8)), (21, "just one line"), (22, "just one line")]


def cut_lines(text):
    """Chunks as lists of lines, by the stated rule."""
    import hashlib
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    asks = [i > 0 and (h[i - 1] * 31 + h[i]) % 2 == 0 for i in range(len(lines))]
    out, now = [], []
    for i, x in enumerate(lines):
        now.append(x)
        if i == len(lines) - 1 or asks[i] and not asks[i - 1]:
            out.append(now)
            now = []
    return out


def test_line_dedup(frame, odd, shared_lines):
    rows = odd + shared_lines
    got = dedup_lines(frame(rows), counted=False)
    assert got.columns == frame([]).columns
    seen, want = {}, collections.Counter()
    for i, t in sorted(set(rows) - {r for r in rows if r[1] is None}, key=lambda r: (r[0] is not None, r[0], r[1])):
        for c in cut_lines(t):
            if len(c) > 1 and sum(x.strip(" ") != "" for x in c) > 1:
                seen.setdefault("\n".join(c), (i, t))
    for i, t in rows:
        if t is None:
            want[i, None] += 1
            continue
        kept, own = [], set()
        for c in cut_lines(t):
            k = "\n".join(c)
            if k in seen and (seen[k] != (i, t) or k in own):
                continue
            own.add(k)
            kept.append(k)
        want[i, "\n".join(kept)] += 1
    # Equal doc_ids are ordered by a hash of their texts, so those are left to the test of counts.
    twice = {i for i, n in collections.Counter(i for i, _ in set(rows)).items() if n > 1}
    assert {k: n for k, n in collections.Counter((r.doc_id, r.text) for r in got.collect()).items() if k[0] not in twice} == \
        {k: n for k, n in want.items() if k[0] not in twice}
    removed = {r.doc_id for r in dedup_lines(frame(rows).select("doc_id", "text"), counted=True).where("_removed_lines > 0").collect()}
    assert {11, 12, 14, 20} <= removed and not removed & {10, 18, 21, 22}
    assert dedup_lines(frame([])).count() == 0


def test_line_dedup_of_short_passages(frame, odd, prose):
    """Passages of 2 to 10 lines in different surroundings go whole, their first occurrence and all other lines stay."""
    rows, want = [], {}
    for g in range(45):
        n = 2 + g % 9
        passage, other = prose(8 * n, 7000 + g, 8), [prose(24, 7100 + 10 * g + k, 8) for k in range(4)]
        passage = passage.replace("\n", "\n \n", 1) if g % 3 else passage
        rows += [(100 + 2 * g, f"{other[0]}\n{passage}\n{other[1]}"), (101 + 2 * g, f"{other[2]}\n{passage}\n{other[3]}")]
        want |= {100 + 2 * g: rows[-2][1], 101 + 2 * g: f"{other[2]}\n{other[3]}"}
    rows += [(300, "same line here\n" * 30), (301, "a b\nc d\na b\nc d\na b"), (302, "\n\n\n"), (303, "just one"), (304, "just one")]
    want |= {300: "same line here\nsame line here\n", 301: "a b\nc d\na b", 302: "\n\n\n", 303: "just one", 304: "just one"}
    got = dedup_lines(frame(rows).select("doc_id", "text"), counted=True, passages=True).collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(rows)
    before = {i: t.count("\n") + 1 for i, t in rows}
    assert all(r["_lines"] == before[r.doc_id] and r["_removed_lines"] == before[r.doc_id] - (r.text.count("\n") + 1) for r in got)
    null = dedup_lines(frame(odd), counted=False, passages=True)
    assert null.columns == frame([]).columns and null.count() == len(odd)
    assert {r.doc_id: r.text for r in null.collect()}[2] is None and dedup_lines(frame([]), passages=True).count() == 0


def test_the_first_copy_of_each_passage_stays_whole(spark):
    """Passages that overlap: a pair of lines met twice stands somewhere afterwards, whatever else goes around it."""
    rng = np.random.default_rng(9)
    texts = ["a\nb", "a\nb\nc", "b\nc", "q\nq\nq\nq", "z\n\nq\nq\nw", "a b\nc d\na b\nc d\na b",
             *["\n".join(rng.choice(list("klmnop"), rng.integers(2, 9))) for _ in range(40)]]
    got = dict(dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), passages=True).collect())
    assert [got[i] for i in range(6)] == ["a\nb", "b\nc", "", "q\nq", "z\n\nw", "a b\nc d\na b"]

    def pairs(t):
        lines = [x for x in t.split("\n") if x.strip()]
        return set(zip(lines, lines[1:]))

    counts = collections.Counter(p for t in texts for p in pairs(t))
    left = set().union(*[pairs(t) for t in got.values()])
    assert all(p in left for p, n in counts.items() if n > 1) and sum(map(len, got.values())) < sum(map(len, texts))


def test_boundaries_follow_the_content():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 20_000).astype(np.uint8)
    ends = boundaries(data)
    shifted = boundaries(np.concatenate([rng.integers(97, 123, 777).astype(np.uint8), data])) - 777
    assert len(set(ends) - set(shifted)) <= 2 and ends[-1] == len(data) and (np.diff(ends, prepend=0) <= 512).all()
    assert boundaries(np.zeros(5000, np.uint8))[-1] == 5000 and len(boundaries(np.empty(0, np.uint8))) == 0
    text = "é中x" * 4000
    raw = text.encode()
    at = [0, *boundaries(np.frombuffer(raw, np.uint8)).tolist()]
    assert "".join(raw[a:b].decode() for a, b in zip(at, at[1:], strict=False)) == text


def test_substring_dedup(frame, odd, prose):
    passage = prose(60, 31)
    rows = odd + [(50, f"{prose(33, 32)} {passage} {prose(20, 33)}"), (51, f"{prose(8, 34)}\n{passage}"), (52, f"é{passage} {prose(70, 35)}"),
                  (53, prose(90, 36)), (54, prose(14, 31)), (55, f"{prose(5, 37)} {prose(200, 38)} {prose(5, 39)} {prose(200, 38)}")]
    got = repeated_passages(frame(rows)).collect()
    text = {i: t for i, t in rows}
    found = {r.doc_id for r in got}
    assert {51, 52, 55} <= found and not found & {50, 53, 54, 3, 4, 5}
    for r in got:
        if r.doc_id in (51, 52, 55):
            part = text[r.doc_id].encode()[r.start:r.start + r.bytes].decode()
            assert part in text[r.first_doc_id] and r.words >= 16
    out = {r.doc_id: r.text for r in dedup_substrings(frame(rows)).collect()}
    assert out[50] == text[50] and out[53] == text[53] and out[2] is None and out[3] == ""
    for i in (51, 52):
        raw = text[i].encode()
        for r in got:
            if r.doc_id == i:
                raw = raw[:r.start] + b"\0" * r.bytes + raw[r.start + r.bytes:]
        assert out[i] == raw.replace(b"\0", b"").decode()
    assert dedup_substrings(frame(rows)).count() == len(rows) and repeated_passages(frame([])).count() == 0
    assert dedup_substrings(frame(rows)).columns == frame([]).columns


def test_whole_tables_against_brute_force(spark):
    from placewatch.llm import queries as q
    from .conftest import SF
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    seen, want = set(), set()
    for i, t in sorted(rows):
        raw = (t or "").encode()
        data = np.frombuffer(raw, np.uint8)
        at, run = [0, *boundaries(data).tolist()], []
        space = np.isin(data, [32, 9, 10, 11, 12, 13])
        begins = ~space & np.append(True, space[:-1])
        for a, b in [*zip(at, at[1:], strict=False), (None, None)]:
            if a is not None and raw[a:b] in seen:
                run.append((a, b))
                continue
            if run and int(begins[run[0][0]:run[-1][1]].sum()) >= 16:
                want.add((i, run[0][0], run[-1][1] - run[0][0]))
            run = []
            if a is not None:
                seen.add(raw[a:b])
    assert {(r.doc_id, r.start_byte, r.n_bytes) for r in q.op5_substring_dedup(spark, SF).collect()} == want
    fps = {i: simhash(t) for i, t in rows}
    root = links(fps, [(a, b) for a, b in itertools.combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in q.op4_simhash_near_dedup(spark, SF).collect()} == {(i, f"{f:016x}", root[i]) for i, f in fps.items()}


def test_texts_after_substring_dedup_against_brute_force(spark):
    """The registered query returns every document, those without a passage too, with what is left of its text."""
    import hashlib

    from placewatch.llm import queries as q
    from .conftest import SF
    seen, want = set(), {}
    for i, t in sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()):
        raw, kept, run, lost = (t or "").encode(), b"", [], [0, 0]
        at = [0, *boundaries(np.frombuffer(raw, np.uint8)).tolist()]
        for a, b in [*zip(at, at[1:], strict=False), (len(raw), len(raw))]:
            if a < b and raw[a:b] in seen:
                run.append((a, b))
                continue
            if run:
                first, last = run[0][0], run[-1][1]
                words = len(re.findall(rb"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]", raw[:last])) - len(re.findall(rb"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]", raw[:first]))
                if words >= 16:
                    lost = [lost[0] + last - first, lost[1] + words]
                else:
                    kept += raw[first:last]
            run = []
            seen.add(raw[a:b])
            kept += raw[a:b]
        want[i] = (*lost, None if t is None else len(kept.decode()), None if t is None else hashlib.md5(kept).hexdigest())
    got = q.QUERIES["op5_substring_dedup_texts"](spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert any(w[0] for w in want.values()) and not all(w[0] for w in want.values())
