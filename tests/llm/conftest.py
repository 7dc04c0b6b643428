import random
import re

import pytest

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def prose():
    """Invented words, the same each run."""
    rng = random.Random(5)
    known = ["".join(rng.choice("abdeghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(3000)]

    def make(words, seed, per_line=0):
        own = random.Random(seed)
        picked = [own.choice(known) for _ in range(words)]
        if not per_line:
            return " ".join(picked)
        return "\n".join(" ".join(picked[i:i + per_line]) for i in range(0, words, per_line))
    return make


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with extra columns whose names the operators use themselves."""
    extra = ["_row", "row", "key", "node", "fp", "shard", "slot", "place", "score", "_words", "_h", "lines", "_lines", "h", "root"]

    def make(rows):
        data = [(i, t, *range(len(extra))) for i, t in rows]
        return spark.createDataFrame(data, "doc_id long, text string, " + ", ".join(f"{c} int" for c in extra))
    return make


@pytest.fixture(scope="session")
def odd(prose):
    """Null ids and texts, empty and blank texts, repeated rows, a text of one very long word and one of very many words."""
    return [(1, prose(60, 1)), (1, prose(60, 1)), (None, prose(60, 1)), (None, None), (2, None), (3, ""), (4, " \n\t"), (5, "one"),
            (6, "é" * 50_000), (7, prose(30_000, 2, 12)), (8, prose(60, 3)), (8, prose(60, 4)), (9, "a b\x1cc 　 <|endoftext|> it's 12, ok")]


def links(ids, linked):
    """Component of each id: the smallest one reachable."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
