"""Token ids in files, compressed by Re-Pair grammars, with random access.

Documents are put in ascending doc_id order over range partitions. A partition
is written as blocks of whole documents; the ids of a block are cut into
sections, and each section is a grammar of its own: again and again the
frequent pairs of neighbours become nonterminals, whose rules and expansion
lengths are stored beside the remaining symbols.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import encoder

#: Symbols are stored in 16 bits: ids below ``2**16 - rules``, then one symbol per rule.
SYMBOLS = 2**16
#: Ids in a section and, at least, in a block.
SECTION = 2**19
#: Pairs replaced in a round, the least count of such a pair, and rounds in a section.
PAIRS, LEAST, ROUNDS = 4096, 5, 4

SECTION_TYPE = "struct<symbols: binary, rules: binary, lengths: binary, levels: array<int>, n_tokens: int>"
BLOCKS = f"part int, block int, before long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, sections array<{SECTION_TYPE}>"

_SLOTS = 2**18


def _chosen(pairs: np.ndarray, room: int) -> np.ndarray:
    """The most frequent pairs, the most frequent first (ties mixed), each in a slot of its own of the look-up table."""
    s = np.sort(pairs)
    # In sorted order a pair that is met LEAST times equals the one LEAST - 1 places on.
    s = s[:-(LEAST - 1)][s[LEAST - 1:] == s[:-(LEAST - 1)]]
    first = np.flatnonzero(np.append(s[:1] == s[:1], s[1:] != s[:-1]))
    count = np.diff(np.append(first, len(s))) + LEAST - 1
    often = np.arange(len(first))
    take = min(PAIRS, room)
    if len(often) > take:
        often = often[np.argpartition(-count[often], take - 1)[:take]] if take else often[:0]
    found = s[first[often]]
    found = found[np.lexsort((_slot(found), -count[often]))]
    _, alone = np.unique(_slot(found), return_index=True)
    return found[np.sort(alone)]


def _slot(pairs: np.ndarray) -> np.ndarray:
    return (pairs * np.uint32(2654435769)) >> np.uint32(14)


def compress(ids: np.ndarray, first_rule: int) -> dict:
    """The grammar of a section: ``symbols``, ``rules`` (pairs), ``lengths`` of their expansions, and the rounds' first rules."""
    seq = ids.astype(np.uint16)
    left, right, lengths, levels = [], [], [np.ones(first_rule, np.uint32)], []
    next_symbol = first_rule
    for _ in range(ROUNDS):
        if len(seq) < 2:
            break
        wide = seq.astype(np.uint32)
        pairs = wide[:-1] << np.uint32(16)
        pairs |= wide[1:]
        found = _chosen(pairs, SYMBOLS - next_symbol)
        if not len(found):
            break
        rank = np.full(_SLOTS, len(found), np.uint16)
        rank[_slot(found)] = np.arange(len(found), dtype=np.uint16)
        own = rank.take(_slot(pairs).astype(np.intp))
        np.putmask(own, np.append(found, np.uint32(0)).take(own.astype(np.intp)) != pairs, np.uint16(len(found)))
        # In a run of one id every second pair is left out; of two overlapping pairs the more frequent is replaced.
        run = np.flatnonzero((own[1:] == own[:-1]) & (own[1:] < len(found))) + 1
        if len(run):
            first = np.maximum.accumulate(np.where(np.diff(run, prepend=-1) != 1, np.arange(len(run)), 0))
            own[run[(np.arange(len(run)) - first) % 2 == 0]] = len(found)
        best = own < len(found)
        best[1:] &= own[1:] < own[:-1]
        best[:-1] &= own[:-1] < own[1:]
        at = np.flatnonzero(best)
        used = np.bincount(own[at], minlength=len(found)) >= 2
        at = at[used[own[at]]]
        if not len(at):
            break
        number = np.cumsum(used, dtype=np.uint32) - 1 + next_symbol
        kept = found[used]
        seq[at] = number[own[at]]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq = seq.take(np.flatnonzero(stay))
        size = np.concatenate(lengths)
        a, b = (kept >> np.uint32(16)).astype(np.uint16), (kept & np.uint32(0xFFFF)).astype(np.uint16)
        left.append(a)
        right.append(b)
        lengths.append(size[a] + size[b])
        levels.append(next_symbol)
        next_symbol += len(kept)
    rules = np.stack([np.concatenate(left), np.concatenate(right)], 1) if left else np.empty((0, 2), np.uint16)
    return {"symbols": seq.astype("<u2").tobytes(), "rules": rules.astype("<u2").tobytes(),
            "lengths": (np.concatenate(lengths[1:]) if left else np.empty(0)).astype("<u4").tobytes(),
            "levels": [first_rule, *levels], "n_tokens": len(ids)}


def _undo(seq: np.ndarray, rules: np.ndarray, levels: list[int]) -> np.ndarray:
    """Undo the rounds, the last first: rules of a round only name symbols that were there before it."""
    first, *starts = levels
    for start in reversed(starts):
        pair = seq >= start
        to = np.arange(len(seq)) + np.cumsum(pair) - pair
        out = np.empty(len(seq) + int(pair.sum()), np.uint16)
        out[to] = seq
        rule = rules[seq[pair] - first]
        out[to[pair]] = rule[:, 0]
        out[to[pair] + 1] = rule[:, 1]
        seq = out
    return seq


def expand(section: dict, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a section; only the symbols that cover them are expanded."""
    seq, rules = np.frombuffer(section["symbols"], "<u2"), np.frombuffer(section["rules"], "<u2").reshape(-1, 2)
    levels, stop = list(section["levels"]), section["n_tokens"] if stop is None else stop
    # What each symbol stands for lies in one array: an id at its own place, rules behind the ids.
    lengths = np.frombuffer(section["lengths"], "<u4").astype(np.int32)
    size = np.concatenate([np.ones(levels[0], np.int32), lengths])
    place = np.concatenate([np.arange(levels[0], dtype=np.int32), levels[0] + np.cumsum(lengths, dtype=np.int32) - lengths])
    meaning = np.concatenate([np.arange(levels[0], dtype=np.uint16), _undo(np.arange(levels[0], levels[0] + len(rules), dtype=np.uint16), rules, levels)])
    sizes = size[seq]
    ends = np.cumsum(sizes)
    i, j = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
    first = int(ends[i - 1]) if i else 0
    seq, sizes, ends = seq[i:j], sizes[i:j], ends[i:j] - first
    if not len(seq):
        return np.empty(0, "<u4")
    at = np.repeat(place[seq] - (ends - sizes), sizes)
    at += np.arange(len(at), dtype=np.int32)
    return meaning[at][start - first:max(start, stop) - first].astype("<u4")


def token_blocks(documents: DataFrame, tokenizer: str, vocabulary: int, end_id: int = 0) -> DataFrame:
    """Blocks (columns ``BLOCKS``) of whole documents in ascending doc_id order, ready to be written.

    Each document's ids are those of its whole text (null: empty), then
    ``end_id``. A null doc_id comes first; equal doc_ids are ordered by their
    texts, so repeated rows stay rows. Other columns are ignored; an empty
    table gives no block. ``vocabulary``: number of ids, below 65,536.
    """
    if not 0 < vocabulary < SYMBOLS:
        raise ValueError("ids must fit 16 bits, with room for rules")
    end = int(end_id).to_bytes(4, "little")

    def blocks(batches) -> Iterator:
        import pyarrow as pa

        part, block, before = TaskContext.get().partitionId(), 0, 0
        encode, held, sizes, doc_ids = encoder(tokenizer).column, [], [], []
        section = pa.struct([("symbols", pa.binary()), ("rules", pa.binary()), ("lengths", pa.binary()),
                             ("levels", pa.list_(pa.int32())), ("n_tokens", pa.int32())])

        def written():
            ids = np.frombuffer(b"".join(held), "<u4")
            cut = [compress(ids[i:i + SECTION], vocabulary) for i in range(0, len(ids), SECTION)]
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()),
                pa.array([doc_ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([cut], pa.list_(section))],
                ["part", "block", "before", "n_tokens", "doc_ids", "doc_tokens", "sections"])

        total = 0
        for batch in batches:
            for i, ids in enumerate(encode(batch.column(1), end)):
                held.append(ids)
                sizes.append(len(ids) // 4)
                doc_ids.append(batch.column(0)[i].as_py())
                total += sizes[-1]
                if total >= SECTION:
                    yield written()
                    block, before = block + 1, before + total
                    held, sizes, doc_ids, total = [], [], [], 0
        if held:
            yield written()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    in_order = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return in_order.mapInArrow(blocks, BLOCKS)


def read_documents(blocks: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (binary), from written blocks.

    Starts need one number per partition (their tokens); blocks know their place inside the partition.
    """
    sums = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    starts = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))

    def decoded(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                ids = np.concatenate([expand(s) for s in row["sections"]]).tobytes()
                sizes = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(ends - sizes + row["part_start"] + row["before"], pa.int64()),
                    pa.array(sizes, pa.int64()), pa.array([ids[4 * (e - n):4 * e] for e, n in zip(ends, sizes, strict=True)], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"])

    return blocks.join(starts, "part").mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids binary")
