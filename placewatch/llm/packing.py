"""Vector bin packing of examples into sequences: dot-product heuristic under three limits at once.

An example is a vector (tokens, one segment, loss-bearing tokens). The open
sequence takes the waiting example whose vector has the largest dot product
with what the sequence has left; when none fits and cutting is allowed, the
longest is cut to fill it. Each task packs its own rows in blocks of a fixed
number of examples, so memory is bounded and no shuffle is needed.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

SEQUENCES = ("sequence_id long, n_tokens int, ids binary, "
             "segments array<struct<doc_id: long, start: long, length: int, offset: int, loss_tokens: int, doc_tokens: long>>")


@dataclasses.dataclass(frozen=True)
class Limits:
    """Of one sequence. ``cut``: examples may be cut; a gap of under ``least_cut`` tokens is left as padding instead.

    Without ``cut``, an example over a limit gets a sequence of its own, so that no token is lost.
    """

    tokens: int = 1024
    segments: int = 64
    loss_tokens: int = 1024
    cut: bool = True
    least_cut: int = 16
    block: int = 2048


class Item:
    """A piece of an example: its ids and loss flags from ``start`` to ``stop``."""

    __slots__ = ("doc_id", "ids", "loss", "start", "stop")

    def __init__(self, doc_id, ids, loss, start, stop):
        self.doc_id, self.ids, self.loss, self.start, self.stop = doc_id, ids, loss, start, stop

    def vector(self) -> tuple[int, int, int]:
        n = self.stop - self.start
        return n, 1, n if self.loss is None else int(self.loss[self.start:self.stop].sum())

    def head(self, limits: Limits, room: tuple[int, int, int]) -> int:
        """The longest head, in tokens, that fits the room."""
        n = min(self.stop - self.start, int(room[0]))
        if self.loss is None:
            return min(n, int(room[2]))
        return min(n, int(np.searchsorted(np.cumsum(self.loss[self.start:self.stop]), room[2], side="right")))


def full_pieces(item: Item, limits: Limits) -> Iterator[Item]:
    """Pieces of an example that each fill a sequence, then the rest."""
    whole = (limits.tokens, limits.segments, limits.loss_tokens)
    while limits.cut and item.stop - item.start > 0 and (n := item.head(limits, whole)) < item.stop - item.start:
        yield Item(item.doc_id, item.ids, item.loss, item.start, item.start + n)
        item = Item(item.doc_id, item.ids, item.loss, item.start + n, item.stop)
    yield item


def pack_block(items: list[Item], limits: Limits) -> Iterator[list[Item]]:
    """Sequences that hold each item once."""
    most = np.array([limits.tokens, limits.segments, limits.loss_tokens], np.float64)
    items = list(items)
    vectors = np.array([x.vector() for x in items], np.float64).reshape(-1, 3)
    waiting = np.ones(len(items), bool)
    scaled = vectors / most
    while waiting.any():
        room, held = most.copy(), []
        while True:
            fits = waiting & (vectors <= room).all(axis=1)
            if fits.any():
                best = int(np.argmax(np.where(fits, scaled @ (room / most), -1.0)))
                held.append(items[best])
                waiting[best] = False
                room -= vectors[best]
                continue
            if limits.cut and held and room[0] >= limits.least_cut and room[1] >= 1 and waiting.any():
                longest = int(np.argmax(np.where(waiting, vectors[:, 0], -1.0)))
                x = items[longest]
                n = x.head(limits, room)
                if limits.least_cut <= n < x.stop - x.start:
                    held.append(Item(x.doc_id, x.ids, x.loss, x.start, x.start + n))
                    items[longest] = y = Item(x.doc_id, x.ids, x.loss, x.start + n, x.stop)
                    vectors[longest] = y.vector()
                    scaled[longest] = vectors[longest] / most
            elif not held:  # over a limit by itself and not to be cut
                alone = int(np.argmax(waiting))
                held.append(items[alone])
                waiting[alone] = False
            break
        yield held


def pack_examples(df: DataFrame, tokenizer: str | None = None, end_id: int = 0, limits: Limits = Limits()) -> DataFrame:
    """Packed sequences (columns ``SEQUENCES``), not padded; readers pad to ``limits.tokens``.

    ``df`` has ``doc_id`` and either ``text`` (with ``tokenizer``, the path of
    a vocabulary: ids of the whole text, then ``end_id``; every token bears
    loss) or ``ids`` (binary, little-endian unsigned 32-bit) and ``loss``
    (binary, one byte per id, 0 or 1; null: all bear loss). A null or empty
    text is ``end_id`` alone, a null ``ids`` gives no piece. A null doc_id stays
    null; repeated rows are examples of their own; other columns are ignored;
    an empty table gives no sequence. Sequence ids are unique, not gapless.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), *(["text"] if tokenizer else ["ids", "loss"])]
    end = int(end_id).to_bytes(4, "little")

    def pack(batches):
        import pyarrow as pa

        encode = encoder(tokenizer).column if tokenizer else None
        number = TaskContext.get().partitionId() << 33
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("offset", pa.int32()),
                                   ("loss_tokens", pa.int32()), ("doc_tokens", pa.int64())]))

        def written(sequences: list[list[Item]]):
            nonlocal number
            rows = []
            for held in sequences:
                at, parts = 0, []
                for x in held:
                    n, _, loss = x.vector()
                    parts.append((x.doc_id, x.start, n, at, loss, len(x.ids)))
                    at += n
                rows.append((number, at, b"".join([x.ids[x.start:x.stop].tobytes() for x in held]), parts))
                number += 1
            names = [f.name for f in kind.value_type]
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()),
                pa.array([[dict(zip(names, p, strict=True)) for p in r[3]] for r in rows], kind)], ["sequence_id", "n_tokens", "ids", "segments"])

        waiting, ready = [], []
        for batch in batches:
            encoded = encode(batch.column(1), end) if encode else None
            for i in range(batch.num_rows):
                doc_id = batch.column(0)[i].as_py()
                if encoded:
                    ids, loss = np.frombuffer(next(encoded), "<u4"), None
                else:
                    raw, flags = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                    ids, loss = np.frombuffer(raw or b"", "<u4"), None if flags is None else np.frombuffer(flags, np.uint8)
                if not len(ids):
                    continue
                *full, rest = full_pieces(Item(doc_id, ids, loss, 0, len(ids)), limits)
                ready += [[x] for x in full]
                waiting.append(rest)
                if len(waiting) >= limits.block:
                    ready += pack_block(waiting, limits)
                    waiting = []
                if len(ready) >= 1024:
                    yield written(ready)
                    ready = []
        ready += pack_block(waiting, limits)
        if ready:
            yield written(ready)

    return df.select(*columns).mapInArrow(pack, SEQUENCES)


def pieces(sequences: DataFrame) -> DataFrame:
    """One row per piece of an example: where it lies and its ids."""
    return (sequences.select("sequence_id", "ids", F.explode("segments").alias("s"))
            .select("s.doc_id", "s.start", F.col("s.length").cast("long").alias("length"),
                    F.expr("substring(ids, s.offset * 4 + 1, s.length * 4)").alias("ids"), "s.doc_tokens",
                    "sequence_id", F.col("s.offset").cast("long").alias("offset"), "s.loss_tokens"))
