"""Token ids of whole texts by a public byte-level BPE file of the `tokenizers` library.

The library's pre-tokenizer cuts a text into pieces that it encodes independently of each other. Here the cuts of
plain texts are found by numpy over the bytes, each distinct piece is encoded once by the library, and its ids are
remembered in a table of fixed size. Texts with code points past U+024F, in U+0080-U+00BF, x or / signs of Latin-1,
rare white space, contractions or special-token strings go to the library as they are, so ids are the library's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .arrowtext import U, buffers, prefix_hash, slices, span_hash

SLOTS = 1 << 21  # pieces remembered by a worker, 16 bytes each
POOL = 8_000_000  # ids remembered by a worker

# byte classes: 0 space, 1 other white space, 2 letter, 3 digit, 4 other, 5 not plain
CLASS = np.full(256, 5, np.uint8)
CLASS[0x20] = 0
CLASS[[0x09, 0x0A, 0x0D]] = 1
CLASS[0x21:0x7F] = 4
CLASS[0x41:0x5B] = CLASS[0x61:0x7B] = 2
CLASS[0x30:0x3A] = 3
CLASS[0x80:0xC0] = 2  # continuation bytes; plain only after the leads below
CLASS[0xC3:0xCA] = 2


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _spread(off: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions off[i] .. off[i] + size[i] - 1 for every i, one after the other."""
    total = int(size.sum())
    begin = np.cumsum(size) - size
    return np.repeat(off - begin, size) + np.arange(total)


class Encoder:
    """Encodes texts to ids. The file's pre-tokenizer must be ByteLevel with its own pattern."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()]
        self.opens = np.zeros(self.lib.get_vocab_size(), bool)
        for token, i in self.lib.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")  # the byte-level alphabet's sign for a space
        self._forget()

    def _forget(self) -> None:
        self.key = np.zeros(SLOTS, U)
        self.at = np.zeros(SLOTS, np.int32)
        self.len = np.zeros(SLOTS, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _keep(self, ids: np.ndarray) -> int:
        at = self.used
        self.used += len(ids)
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[at : self.used] = ids
        return at

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether each row's cuts are those that numpy finds."""
        c = CLASS[raw]
        bad = c == 5
        if len(raw) > 1:
            bad[:-1] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
            bad[:-1] |= (raw[:-1] == 0x27) & (c[1:] == 2)
        rows = np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1
        plain = np.ones(len(offsets) - 1, bool)
        plain[rows] = False
        whole = raw.tobytes()
        for s in self.special:
            k = whole.find(s)
            while k >= 0:
                plain[np.searchsorted(offsets, k, "right") - 1] = False
                k = whole.find(s, k + 1)
        return plain

    def _learn(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces; (place in the pool, number of ids) of each. Pieces of a space and letters are joined, as
        the library cuts them apart again: a piece's first token begins with the space and no other token does."""
        at, size = np.zeros(len(start), np.int32), np.zeros(len(start), np.int32)
        alone = np.ones(len(start), bool)
        spaced = np.flatnonzero((raw[start] == 0x20) & (end - start > 1) & (CLASS[raw[np.minimum(start + 1, len(raw) - 1)]] == 2))
        groups = [spaced[i : i + 400] for i in range(0, len(spaced), 400)]
        joined = [raw[_spread(start[g], end[g] - start[g])].tobytes().decode() for g in groups]
        for g, e in zip(groups, self.lib.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            first = np.flatnonzero(self.opens[ids])
            if len(first) == len(g):
                at[g] = self._keep(ids) + first
                size[g] = np.diff(np.append(first, len(ids)))
                alone[g] = False
        rest = np.flatnonzero(alone)
        for i, ids in zip(rest, self.library([raw[start[i] : end[i]].tobytes().decode() for i in rest]), strict=True):
            at[i], size[i] = self._keep(ids), len(ids)
        return at, size

    def _cut(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The starts of the pieces of plain rows."""
        c = CLASS[raw]
        white = c < 2
        first = np.ones(len(raw), bool)
        first[1:] = np.where(white[1:], ~white[:-1], (c[:-1] != c[1:]) & (c[:-1] != 0))
        ahead = white[:-1] & ~white[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(raw))]
        ahead[edge - 1] = False
        first[:-1] |= ahead
        first[edge] = True
        return np.flatnonzero(first)

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of each row's ids) of UTF-8 rows."""
        rows = len(offsets) - 1
        plain = self._plain(raw, offsets)
        odd = np.flatnonzero(~plain)
        whole, bounds = raw, offsets
        if len(odd):
            size = np.diff(offsets) * plain
            raw = raw[np.repeat(plain, np.diff(offsets))]
            offsets = np.concatenate([[0], np.cumsum(size)])
        if len(raw):
            start = self._cut(raw, offsets)
            end = np.append(start[1:], len(raw))
            h = span_hash(prefix_hash(raw), start, end)
            h[h == 0] = 1
            slot = (h >> U(20)).astype(np.int64) & (SLOTS - 1)
            at, size = self.at[slot], self.len[slot]
            miss = np.flatnonzero(self.key[slot] != h)
            if len(miss):
                fresh, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
                new_at, new_size = self._learn(raw, start[miss[where]], end[miss[where]])
                at[miss], size[miss] = new_at[back], new_size[back]
                s = slot[miss[where]]
                # of pieces with one slot any may stay, but all three fields must be of the same one
                self.at[s] = np.arange(len(s))
                s, fresh, new_at, new_size = (x[self.at[s] == np.arange(len(s))] for x in (s, fresh, new_at, new_size))
                self.key[s], self.at[s], self.len[s] = fresh, new_at, new_size
            ids = self.pool[_spread(at.astype(np.int64), size.astype(np.int64))]
            ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            out = ends[np.searchsorted(start, offsets)]
        else:
            ids, out = np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        if len(odd):
            parts, sizes, last = [], np.diff(out), 0
            for i, more in zip(odd, self.library([whole[bounds[i] : bounds[i + 1]].tobytes().decode() for i in odd]), strict=True):
                parts += [ids[last : out[i]], more]
                last, sizes[i] = out[i], len(more)
            ids = np.concatenate([*parts, ids[last:]])
            out = np.concatenate([[0], np.cumsum(sizes)])
        if self.used > POOL:
            self._forget()
        return ids, out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(column: pa.Array, path: str, step: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, offsets) of slices of a string column; null: empty."""
    enc = encoder(path)
    raw, offsets, _ = buffers(column)
    for i, j in slices(offsets, step):
        ids, out = enc(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield i, j, ids, out
