"""Token files, packing and sharding: exact round trips."""

import collections
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from placewatch.llm.packing import Item, Limits, full_pieces, pack_block, pack_examples, pieces
from placewatch.llm.repair import compress, expand, read_documents, token_blocks
from placewatch.llm.shards import hypergeometric, matrix_row, shuffle_to_shards
from placewatch.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(PATH)
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def test_encoder_equals_the_tokenizer(whole, odd):
    own, rng = Encoder(PATH), random.Random(3)
    parts = [*"ab Z9.,'\n\t  éß中 　 x's \r\x1c\x85٣Ⅷ́ ", "'s", "'ll", " \n", "  ", "<|endoftext|>"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert own.encode(text) + b"\0\0\0\0" == whole(text).tobytes(), repr(text)
    for _, text in odd:
        assert own.encode(text or "") + b"\0\0\0\0" == whole(text).tobytes()


@pytest.mark.parametrize("ids", [[], [5], [1, 1], [7] * 5000, [1, 2, 3] * 900, list(range(300)) * 8, [0, 50256] * 40])
def test_grammar_round_trip(ids):
    ids = np.array(ids, np.uint32)
    section = compress(ids, 50_257)
    assert (expand(section) == ids).all()
    for i, j in itertools.product(range(0, len(ids) + 1, max(1, len(ids) // 7)), repeat=2):
        if i <= j:
            assert (expand(section, i, j) == ids[i:j]).all()
    if len(ids) > 500:
        assert len(section["symbols"]) < 1.2 * len(ids)  # 2 bytes a symbol, fewer symbols than ids


def test_token_files(spark, frame, odd, whole, folder):
    token_blocks(frame(odd), PATH, 50_257).write.parquet(folder + "/blocks")
    got = sorted(read_documents(spark.read.parquet(folder + "/blocks")).collect(), key=lambda r: r.start)
    assert len(got) == len(odd)
    assert [r.doc_id for r in got] == sorted((i for i, _ in odd), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in got) == collections.Counter((i, whole(t).tobytes()) for i, t in odd)
    token_blocks(frame([]), PATH, 50_257).write.parquet(folder + "/none")
    assert read_documents(spark.read.schema("part int, block int, before long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, "
                          "sections array<struct<symbols: binary, rules: binary, lengths: binary, levels: array<int>, n_tokens: int>>")
                          .parquet(folder + "/none")).count() == 0


def test_packed_documents(frame, odd, whole):
    rows = pieces(pack_examples(frame(odd), PATH)).collect()
    left = collections.Counter((i, whole(t).tobytes()) for i, t in odd)
    # Pieces that follow each other make up whole documents; equal rows give equal pieces.
    by_start = collections.defaultdict(list)
    for r in rows:
        by_start[r.doc_id, r.doc_tokens].append((r.start, r.length, bytes(r.ids)))
    for (doc_id, n), found in by_start.items():
        copies = sum(k for (i, ids), k in left.items() if i == doc_id and len(ids) == 4 * n)
        assert sum(x[1] for x in found) == n * copies
        for (i, ids), k in left.items():
            if i == doc_id and len(ids) == 4 * n and k == copies:
                assert all(ids[4 * s:4 * (s + m)] == b for s, m, b in found)
    assert sum(r.length for r in rows) == sum(len(whole(t)) for _, t in odd)
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        held.sort()
        assert [o for o, _ in held] == [0, *itertools.accumulate(n for _, n in held)][:-1] and sum(n for _, n in held) <= 1024
    assert pieces(pack_examples(frame([]), PATH)).count() == 0


def test_three_limits_at_once():
    rng = np.random.default_rng(1)
    limits = Limits(tokens=100, segments=4, loss_tokens=40, least_cut=3)
    items = [Item(i, np.arange(n, dtype="<u4"), rng.integers(0, 2, n).astype(np.uint8), 0, n) for i, n in enumerate(rng.integers(1, 260, 80).tolist())]
    cut = [list(full_pieces(x, limits)) for x in items]
    sequences = [[x] for p in cut for x in p[:-1]] + list(pack_block([p[-1] for p in cut], limits))
    seen = collections.defaultdict(list)
    for held in sequences:
        n, k, loss = np.sum([x.vector() for x in held], axis=0)
        assert n <= 100 and k <= 4 and loss <= 40
        for x in held:
            seen[x.doc_id].append((x.start, x.stop))
    for x in items:
        assert [p for pair in sorted(seen[x.doc_id]) for p in pair][1:-1:2] == [p for pair in sorted(seen[x.doc_id]) for p in pair][2::2]
        assert min(seen[x.doc_id])[0] == 0 and max(seen[x.doc_id])[1] == len(x.ids)


def test_examples_stay_whole_without_cutting(spark):
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (30, 80, 50, 20, 300, 0)]
    df = spark.createDataFrame([(i, bytearray(b), None) for i, b in enumerate(ids)], "doc_id long, ids binary, loss binary").coalesce(1)
    got = pieces(pack_examples(df, limits=Limits(tokens=100, loss_tokens=100, cut=False))).collect()
    assert sorted((r.doc_id, r.length) for r in got) == [(0, 30), (1, 80), (2, 50), (3, 20), (4, 300)]
    assert {r.sequence_id for r in got if r.doc_id == 4}.isdisjoint(r.sequence_id for r in got if r.doc_id != 4)
    assert len({r.sequence_id for r in got}) == 3  # 80 + 20, 50 + 30, 300


def test_hypergeometric_law():
    rng = np.random.default_rng(0)
    good, bad, n = 30, 50, 20
    got = np.array([hypergeometric(rng, good, bad, n) for _ in range(20_000)])
    assert abs(got.mean() - n * good / (good + bad)) < 0.06
    assert abs(got.var() - n * (good / 80) * (bad / 80) * (60 / 79)) < 0.12
    big = [hypergeometric(rng, 6 * 10**9, 4 * 10**9, 10**9) for _ in range(30)]
    assert abs(np.mean(big) / 6e8 - 1) < 1e-4
    assert hypergeometric(rng, 5, 0, 3) == 3 and hypergeometric(rng, 0, 5, 3) == 0 and hypergeometric(rng, 4, 4, 8) == 4


def test_matrix_margins():
    before, sizes = np.array([0, 5, 5, 17, 40, 41]), [11, 10, 10, 10]
    rows = np.array([matrix_row(p, before, sizes, 3) for p in range(5)])
    assert (rows.sum(axis=1) == np.diff(before)).all() and rows.sum(axis=0).tolist() == sizes and (rows >= 0).all()


def test_shards(frame, odd, rows):
    many = odd + [(100 + i, f"t{i}") for i in range(500)]
    got = shuffle_to_shards(frame(many).repartition(7), shards=8, rows_per_file=16, stage=True)
    assert rows(got.select("row.doc_id", "row.text", "row.shard")) == sorted(((i, t, 5) for i, t in many), key=lambda r: tuple((v is None, str(v)) for v in r))
    by = collections.defaultdict(list)
    for r in got.select("shard", "slot", "row.doc_id").collect():
        by[r.shard].append((r.slot, r.doc_id))
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in by.values())
    sizes = [len(v) for v in by.values()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 1
    # The order has nothing to do with the input's.
    order = [d for s in sorted(by) for _, d in sorted(by[s], key=lambda x: x[0]) if d and d >= 100]
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.15
    assert shuffle_to_shards(frame([]), stage=True).count() == 0


def test_query_digests(spark):
    from placewatch.llm import queries as q
    from .conftest import SF
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = q.op10_sharding(spark, SF).collect()
    assert len(got) == len(text)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    t = Tokenizer.from_file(PATH)
    at = 0
    for r in q.op1_token_ids(spark, SF).orderBy("doc_id").collect():
        ids = np.array(t.encode(text[r.doc_id] or "", add_special_tokens=False).ids + [0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    packed = q.op6_packing(spark, SF)
    assert packed.agg(F.sum("length")).first()[0] == at
    assert at / (1024 * packed.select("sequence_id").distinct().count()) > 0.98


def test_words_with_a_mark_take_one_entry_until_met_again():
    import public_tokenizers
    from tokenizers import Tokenizer

    from placewatch.llm.tokens import Encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    e, text = Encoder(path), "a qwzlk, b qwzlk, c qwzlk. d qwzlk"
    first = e.encode("a qwzlk,")
    assert "qwzlk" in e.words and "qwzlk," not in e.words
    e.encode("a qwzlk,")
    assert "qwzlk," in e.words
    whole = Tokenizer.from_file(path)
    for got, t in ((first, "a qwzlk,"), (e.encode(text), text)):
        assert [int.from_bytes(got[i:i + 4], "little") for i in range(0, len(got), 4)] == whole.encode(t, add_special_tokens=False).ids


def test_columns_of_texts_equal_the_tokenizer(whole, odd, monkeypatch):
    import pyarrow as pa

    from placewatch.llm import tokens

    own, rng = Encoder(PATH), random.Random(4)
    parts = [*"abZ9.,'éß×ɿʰ中x\n\t\u3000\x1c\x85\xa0", "the", "'s", "\n\n", "İ", "٣", "<|endoftext|>", "\u200b", "🙂"]
    plain = [" ".join("".join(rng.choice(parts[:16]) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 9))) for _ in range(2000)]
    mixed = ["".join(rng.choice([*parts, " ", " ", " of,", "  "]) for _ in range(rng.randint(0, 20))) for _ in range(2000)]
    texts = [*plain, *mixed, *(t for _, t in odd), None, "", " ", "\n", " a", "a "]
    for at_once, known in ((2**23, 500_000), (500, 300), (1, 0)):
        monkeypatch.setattr(tokens, "AT_ONCE", at_once)
        monkeypatch.setattr(tokens, "KNOWN", known)
        for kind in (pa.string(), pa.large_string()):
            got = list(own.column(pa.array(texts[-800 if at_once == 1 else 0:], kind), b"\0\0\0\0"))
            assert [bytes(g) for g in got] == [whole(t).tobytes() for t in texts[-800 if at_once == 1 else 0:]]
            assert own.known is None or len(own.known[0]) <= known
    for some in ([], [None], ["a  b"], [" "], ["\n"], ["a"]):
        assert list(own.column(pa.array(["x", *some, "y"], pa.string()).slice(1, len(some)))) == [whole(t).tobytes()[:-4] for t in some]


def test_a_pre_token_reaches_the_model_once(monkeypatch):
    import pyarrow as pa

    own, new = Encoder(PATH), []
    made = own._new_pieces
    monkeypatch.setattr(own, "_new_pieces", lambda pieces: new.extend(pieces.to_pylist()) or made(pieces))
    list(own.column(pa.array(["a qwzlk, qwzlk.\nqwzlk qwzlk###", "b qwzlk"])))
    assert collections.Counter(new) == collections.Counter(["###", ",", ".", "\n", " qwzlk", "qwzlk"])
    list(own.column(pa.array(["c qwzlk.\nqwzlk,", "d qwzlk###"])))
    assert len(new) == 6
    # Tasks go through columns, so what a worker keeps from task to task is Arrow's, not one Python object per word.
    assert not own.words


def test_workers_keep_little_of_many_words(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    from placewatch.llm import tokens

    own, rng = Encoder(PATH), random.Random(6)
    texts = [" ".join("".join(rng.choice("abdeghilmnorstu") for _ in range(9)) for _ in range(1000)) for _ in range(40)]
    released = []
    monkeypatch.setattr(pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": staticmethod(lambda: released.append(1))}))
    monkeypatch.setattr(tokens, "AT_ONCE", 100_000)
    tracemalloc.start()
    try:
        for _ in own.column(pa.array(texts)):
            pass
        kept = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    # 40,000 words as dictionary entries take over 4 MB.
    assert kept < 1_000_000 and own.known[0].nbytes < 16 * 40_010 and len(released) >= 4
