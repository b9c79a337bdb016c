"""Whole-text encoding with the ``tokenizers`` library, each distinct piece once per worker.

A text is cut before every space that a visible character follows, and between a Latin letter and
an ASCII punctuation mark. The byte-level pre-tokenizer always starts a new match there, so the ids
of the pieces, joined, are the ids of the whole text. Pieces are dictionary-encoded by Arrow; only
pieces not met before go through the library: a run of Latin letters straight to its BPE model (such
a piece is one match of the pre-tokenizer), any other through the whole tokenizer. An added token of the
tokenizer (such as the one that ends texts) has its own id where a text spells it out, as in the library:
it is a piece of its own, and the text before it ends there.
"""

from __future__ import annotations

import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from factloom.llm._common import bytes_view, slices  # noqa: E402

#: Bytes of text that are cut and looked up at a time.
BLOCK_BYTES = 1 << 21
#: Pieces that a worker remembers before it forgets those met only once, and the longest that it remembers.
CACHE_PIECES = 400_000
CACHE_PIECE_BYTES = 64

#: Bytes that may follow a space at a cut: visible ASCII, and lead bytes of blocks without white space.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0xC3:0xE1] = True
_VISIBLE[0xE4:0xF5] = True
#: ASCII letters; last bytes of U+00C0 to U+00FF without the two signs among them; ASCII punctuation.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True

#: One match of the pre-tokenizer: Latin letters, perhaps after a space.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


_LOADED: dict[str, "PieceTokenizer"] = {}


def loaded(path: str) -> "PieceTokenizer":
    """The tokenizer of a file, loaded once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = PieceTokenizer(path)
    return _LOADED[path]


class PieceTokenizer:
    """Encodes Arrow string columns; ``vocab_size`` bounds the ids."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self._begin()

    def _begin(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.met = np.zeros(1 << 14, bool)  # again after it was added
        self.n_ids = self.n_slots = 0

    def _forget(self) -> None:
        """Keep what was met again; if that is most of it, nothing."""
        kept = np.flatnonzero(self.met[: self.n_slots])
        old, starts, lengths, ids = self.slot, self.starts[kept], self.lengths[kept], self.ids
        number = np.full(self.n_slots, -1)
        number[kept] = np.arange(len(kept))
        self._begin()
        if len(kept) > CACHE_PIECES // 2:
            return
        self._room(len(kept), int(lengths.sum()))
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        self.ids[:total] = ids[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]
        self.starts[: len(kept)], self.lengths[: len(kept)] = ends - lengths, lengths
        self.n_ids, self.n_slots = total, len(kept)
        self.slot = {piece: new for piece, slot in old.items() if (new := int(number[slot])) >= 0}

    def _room(self, slots: int, ids: int) -> None:
        """Grow the tables until so many more fit."""
        while self.n_ids + ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n_slots + slots > len(self.starts):
            self.starts, self.lengths, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.met))

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of pieces, joined in any order; each piece's place and number."""
        is_word = np.fromiter((_WORD(p) is not None for p in pieces), bool, len(pieces))
        lengths = np.zeros(len(pieces), np.int64)
        flat = []
        words, others = np.flatnonzero(is_word), np.flatnonzero(~is_word)
        if len(words):
            coded = self.model.encode([pieces[i].decode("latin-1").translate(self.letters) for i in words], is_pretokenized=True, add_special_tokens=False)
            lengths[words] = np.bincount(np.array(coded.word_ids, np.int64), minlength=len(words))
            flat += coded.ids
        if len(others):
            coded = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[i].decode("utf-8", "replace") for i in others], add_special_tokens=False)]
            lengths[others] = [len(ids) for ids in coded]
            for ids in coded:
                flat += ids
        order = np.concatenate([words, others])
        starts = np.zeros(len(pieces), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        return np.array(flat, np.uint32), starts, lengths

    def _add(self, pieces: list[bytes]) -> np.ndarray:
        """Encode pieces and append them to the tables; their slots."""
        slots = np.arange(self.n_slots, self.n_slots + len(pieces))
        for at in range(0, len(pieces), 4096):
            part = pieces[at : at + 4096]
            flat, starts, lengths = self._encode(part)
            self._room(len(part), len(flat))
            here = slice(self.n_slots, self.n_slots + len(part))
            self.starts[here] = self.n_ids + starts
            self.lengths[here] = lengths
            self.ids[self.n_ids : self.n_ids + len(flat)] = flat
            self.n_ids += len(flat)
            self.n_slots += len(part)
        return slots

    def _slots(self, distinct: list[bytes]) -> np.ndarray:
        if self.n_slots > CACHE_PIECES:
            self._forget()
        get = self.slot.get
        found = np.fromiter((get(p, -1) for p in distinct), np.int64, len(distinct))
        missing = np.flatnonzero(found < 0)
        self.met[found[found >= 0]] = True
        if len(missing):
            new = [distinct[i] for i in missing]
            found[missing] = self._add(new)
            self.slot.update((p, s) for p, s in zip(new, found[missing].tolist()) if len(p) <= CACHE_PIECE_BYTES)
        return found

    def _cut_added(self, block: np.ndarray, cut: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Make every added token in a row a piece; a space before it ends what stands before."""
        raw = block.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                end = at + len(token)
                if end <= ends[np.searchsorted(starts, at, side="right") - 1]:
                    if at and raw[at - 1] == 0x20:
                        cut[at - 1] = False
                    cut[at:end] = False
                    cut[at] = cut[end] = True
                    at = raw.find(token, end)
                else:  # half of it in the next row
                    at = raw.find(token, at + 1)

    def blocks(self, column):
        """Yield (first row, ids uint32, offsets int64 of the rows in ids) for blocks of rows.

        A null text counts as empty. A row's ids are never divided between blocks.
        """
        data, offsets = bytes_view(column)
        for i, j in slices(offsets, BLOCK_BYTES):
            block = data[offsets[i] : offsets[j]]
            ends = offsets[i + 1 : j + 1] - offsets[i]
            starts = offsets[i:j] - offsets[i]
            if not len(block):
                yield i, np.zeros(0, np.uint32), np.zeros(j - i + 1, np.int64)
                continue
            cut = np.zeros(len(block) + 1, bool)
            cut[: len(block) - 1] = (block[:-1] == 0x20) & _VISIBLE[block[1:]]
            letter = _LETTER[block]
            letter[1:] |= (block[:-1] == 0xC3) & _LATIN[block[1:]]
            cut[1:-1] |= letter[:-1] & _MARK[block[1:]]
            cut[ends[ends > 0] - 1] &= block[ends[ends > 0] - 1] != 0x20  # a space that ends a row is no cut
            self._cut_added(block, cut, starts, ends)
            cut[starts] = True
            cut[len(block)] = False
            edges = np.flatnonzero(cut).astype(np.int32)
            bounds = np.append(edges, np.int32(len(block)))
            pieces = pa.Array.from_buffers(pa.binary(), len(edges), [None, pa.py_buffer(bounds), pa.py_buffer(block)])
            coded = pieces.dictionary_encode()
            slots = self._slots(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            lengths = self.lengths[slots]
            ends_at = np.cumsum(lengths)
            total = int(ends_at[-1])
            source = np.repeat(self.starts[slots] - (ends_at - lengths), lengths) + np.arange(total)
            rows = np.append(starts, len(block))
            before = np.concatenate([[0], ends_at])
            yield i, self.ids[source], before[np.searchsorted(edges, rows)]
