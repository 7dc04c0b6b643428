"""Token ids of whole texts by a public byte-level BPE, with bounded memories of words.

A space followed by a non-space always starts a new pre-token of this
tokenizer, so a text can be cut at single spaces and equal words share their
ids. Only words not met before reach the tokenizer's model. Columns of texts
are cut, numbered and put together by Arrow, some megabytes at a time.
"""

from __future__ import annotations

import itertools
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

from .common import per_process

#: Entries per cache generation of single texts; two generations are kept, so memory is bounded.
CACHED = 100_000
#: Longer words are encoded each time.
LONGEST = 48
#: Bytes of text that are cut at once, and pre-tokens (and their bytes) that a worker knows from earlier ones.
AT_ONCE, KNOWN, KNOWN_BYTES = 2**23, 500_000, 2**25
#: New pre-tokens that go to the library as one text.
TOGETHER = 100
#: A space before white space or at the end, or what is white space to some engines only.
UNCUT = r" (?:[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)|[\x1c-\x1f\x{85}]"

#: Kinds of bytes in UTF-8 that make pre-tokens: letters (ASCII, and U+00C0 to U+027F but two signs), digits, white space, others of ASCII. Where
#: another byte or an apostrophe is in a word, or white space of two or more, the library's own pattern cuts it.
LETTER, DIGIT, BLANK, SIGN, LEFT = range(5)
KINDS = np.full(256, LEFT, np.uint8)
KINDS[:128] = [LETTER if c.isalpha() else DIGIT if c.isdigit() else BLANK if c in "\t\n\v\f\r" else LEFT if c == "'" else SIGN for c in map(chr, range(128))]
KINDS[0x80:0xC0] = KINDS[0xC3:0xCA] = LETTER


class _Uncut(Exception):
    """The text has spaces next to other white space; it is cut by the tokenizer's own pattern."""


class _Pieces(dict):
    """Ids (little-endian unsigned 32-bit) by pre-token."""

    def __init__(self, model):
        super().__init__()
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names = {b: chr(b) for b in plain}
        names |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in names)}
        self.model, self.names, self.old = model, names, {}

    def ids(self, piece: str) -> bytes:
        shown = piece.encode().decode("latin-1").translate(self.names)
        return self.shown(shown)

    def shown(self, shown: str) -> bytes:
        """Ids of a pre-token that is written as the model writes it."""
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.ids(piece)
        if len(piece) <= LONGEST:
            if len(self) >= CACHED:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class _Words(dict):
    """Ids of a space and the word, by word."""

    def __init__(self, pieces: _Pieces, cut, odd):
        super().__init__()
        self.pieces, self.cut, self.odd, self.old = pieces, cut, odd, {}
        self.marks, self.space = {m: pieces[m] for m in ".,"}, pieces.names[32]

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if word.isalpha():
                # Letters of ASCII are written as they are.
                ids = self.pieces.shown(self.space + word) if word.isascii() else self.pieces.ids(" " + word)
            elif word[-1:] in self.marks and (plain := word[:-1]).isalpha():
                if plain not in self:
                    # Met for the first time: most such words are not met again, and one entry is enough for those.
                    return self[plain] + self.marks[word[-1]]
                ids = self[plain] + self.marks[word[-1]]
            elif not word or word[0].isspace() or word[-1].isspace() or self.odd(word):
                raise _Uncut
            else:
                ids = b"".join(map(self.pieces.__getitem__, self.cut(" " + word)))
        if len(word) <= LONGEST:
            if len(self) >= CACHED:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """``encode(text)`` gives the ids of the whole text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.whole = Tokenizer.from_file(path)
        #: Strings of special tokens: a text that holds one goes to the library as a whole, where it becomes that token.
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        self.odd = regex.compile(r"[\x1c-\x1f\x85]").search  # white space to some engines only
        self.pieces = _Pieces(self.whole.model)
        self.words = _Words(self.pieces, self.cut, self.odd)
        self.uncut = "|".join([UNCUT, *map(re.escape, self.special)])
        #: Of each id: does it start with a space?
        self.spaced = np.zeros(self.whole.get_vocab_size(), bool)
        self.spaced[[i for t, i in self.whole.get_vocab().items() if t.startswith(self.pieces.names[32])]] = True
        self.known = None

    def encode(self, text: str) -> bytes:
        for mark in self.special:
            if mark in text:
                return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        first, cut, rest = text.partition(" ")
        try:
            if first[-1:].isspace() or self.odd(first):
                raise _Uncut
            head = b"".join(map(self.pieces.__getitem__, self.cut(first)))
            return head + b"".join(map(self.words.__getitem__, rest.split(" "))) if cut else head
        except _Uncut:
            pass
        if self.odd(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.pieces.__getitem__, self.cut(text)))

    def column(self, texts, end: bytes = b"") -> Iterator[bytes]:
        """For each text of an Arrow column (null: empty) what ``encode`` gives, then ``end``."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + AT_ONCE, side="right")))
            yield from self._at_once(texts.slice(i, j - i).cast("string"), end)
            pa.default_memory_pool().release_unused()  # else an idle worker keeps the largest it ever took
            i = j

    def _at_once(self, texts, end: bytes) -> Iterator[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        alone = pc.match_substring_regex(texts, self.uncut)
        lists = pc.split_pattern(texts.filter(pc.invert(alone)), " ")
        words, to = lists.flatten(), lists.offsets.to_numpy()
        to = to - to[0]
        first = np.zeros(len(words), bool)
        first[to[:-1]] = True
        ids = self._words(words.filter(pa.array(~first)))
        at, data = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, ids.offset * 8), memoryview(ids.buffers()[2] or b"")
        cuts = at[to - np.arange(len(to))].tolist()
        heads = iter(zip(words.filter(pa.array(first)).to_pylist(), cuts, cuts[1:]))
        for i, other in enumerate(alone.to_pylist()):
            if other:
                yield self.encode(texts[i].as_py()) + end
            else:
                head, low, high = next(heads)
                yield b"".join([*map(self.pieces.__getitem__, self.cut(head)), data[low:high], end])

    def _words(self, words):
        """Ids of a space and the word, for each of the words (none is empty or starts with white space), as Arrow's binary values."""
        import pyarrow as pa

        numbered = words.dictionary_encode()
        pieces, to = self._pre_tokens(numbered.dictionary)
        known, known_ids = self.known or (pieces.slice(0, 0), pa.array([], pa.large_binary()))
        # Known pieces come first and differ, so they keep their numbers.
        every = pa.concat_arrays([known, pieces]).dictionary_encode()
        number, every = every.indices.slice(len(known)), every.dictionary
        ids = pa.concat_arrays([known_ids, self._new_pieces(every.slice(len(known)))])
        self.known = every, ids
        if len(every) > KNOWN or every.nbytes > KNOWN_BYTES:
            own = pa.array(np.flatnonzero(np.bincount(number.to_numpy(), minlength=len(every))))
            kept = every.take(own)
            self.known = (kept, ids.take(own)) if len(kept) <= KNOWN and kept.nbytes <= KNOWN_BYTES else None
        found = ids.take(number)
        at = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)[to]
        return pa.Array.from_buffers(pa.large_binary(), len(to) - 1, [None, pa.py_buffer(at), found.buffers()[2]]).take(numbered.indices)

    def _pre_tokens(self, words):
        """The words, a space before each, cut into pre-tokens, and where each word's begin. Words that are ``LEFT`` stay whole."""
        import pyarrow as pa
        import pyarrow.compute as pc

        spaced = pc.binary_join_element_wise("", words, " ")
        at, data = np.frombuffer(spaced.buffers()[1], np.int32, len(spaced) + 1), np.frombuffer(spaced.buffers()[2] or b"", np.uint8)
        kind = KINDS[data]
        left = kind == LEFT
        left[1:] |= (kind[1:] == BLANK) & (kind[:-1] == BLANK) | (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # multiplication, division
        whole = np.zeros(len(words), bool)
        whole[np.searchsorted(at, np.flatnonzero(left), side="right") - 1] = True
        kind[np.repeat(whole, np.diff(at))] = LEFT
        kind[at[:-1]] = kind[at[:-1] + 1]
        starts = np.ones(len(data), bool)
        starts[1:] = kind[1:] != kind[:-1]
        starts[at[:-1]] = True
        to = np.append(0, np.cumsum(np.add.reduceat(starts, at[:-1], dtype=np.int64))) if len(words) else np.zeros(1, np.int64)
        cuts = np.append(np.flatnonzero(starts), len(data)).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(cuts) - 1, [None, pa.py_buffer(cuts), spaced.buffers()[2]]), to

    def _new_pieces(self, pieces):
        """Ids of each; those that start with a space go to the library together."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(pieces):
            return pa.array([], pa.large_binary())
        spaced = pc.starts_with(pieces, " ")
        some = pieces.filter(spaced)
        cuts = np.append(np.arange(0, len(some), TOGETHER), len(some)).astype(np.int32)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), some), "").to_pylist()
        found = self.whole.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.fromiter(itertools.chain.from_iterable(x.ids for x in found), "<u4")
        starts = np.flatnonzero(self.spaced[ids])
        if len(starts) != len(some):
            raise ValueError("pre-tokens can't be told from each other by their ids")
        joined = pa.Array.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(4 * np.append(starts, len(ids))), pa.py_buffer(ids)])
        others = pa.array(map(self.pieces.ids, pieces.filter(pc.invert(spaced)).to_pylist()), pa.large_binary())
        spaced = spaced.to_numpy(zero_copy_only=False)
        return pa.concat_arrays([joined, others]).take(pa.array(np.where(spaced, np.cumsum(spaced), len(some) + np.cumsum(~spaced)) - 1))


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker."""
    return per_process(f"encoder {path}", lambda: Encoder(path))
