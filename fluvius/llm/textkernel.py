"""Words of a batch of texts as 64-bit hashes, computed on the UTF-8 bytes with numpy: no Python string is ever made."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Word bytes: ASCII letters and digits, and everything beyond ASCII.
WORD = np.zeros(256, bool)
WORD[np.r_[48:58, 65:91, 97:123, 128:256]] = True
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

LOWER = np.arange(256)
LOWER[65:91] += 32
#: Shapes: letters, capitals and digits become one class each, bytes beyond ASCII letters, other characters stay.
SHAPE = np.arange(256)
SHAPE[97:123] = SHAPE[128:256] = ord("a")
SHAPE[65:91] = ord("A")
SHAPE[48:58] = ord("0")

SLICE = 1 << 21  # bytes of text hashed at once; a word longer than that is hashed at once too


def _table(classes: np.ndarray) -> np.ndarray:
    return _RNG_TABLE[classes]


_RNG_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
LOWER_TABLE, SHAPE_TABLE, BYTE_TABLE = _table(LOWER), _table(SHAPE), _RNG_TABLE
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte offsets) of the maximal runs of ``inside`` bytes, and the text that each is in."""
    if not len(data):
        return (np.empty(0, np.int64),) * 3
    on = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # runs end where texts end
    before = np.concatenate([[False], on[:-1]]) & ~edge[:-1]
    after = np.concatenate([on[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(on & ~before), np.flatnonzero(on & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def heads(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, most: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of the first ``n`` bytes of each span, or of all of it if it has no more, for each ``n`` of ``most``."""
    return [hashes(data, starts, np.minimum(ends, starts + n), table) for n in most]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, collapse: bool = False) -> np.ndarray:
    """A hash of the bytes of each span under ``table``; with ``collapse``, of its bytes without those that repeat the one before."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        low = starts[k]
        n = max(1, int(np.searchsorted(ends, low + SLICE, side="right")) - k)
        s, e = starts[k : k + n] - low, ends[k : k + n] - low
        v = table[data[low : low + e[-1]]]
        if collapse:
            keep = np.concatenate([[True], v[1:] != v[:-1]])
            keep[s] = True
            at = np.concatenate([[0], np.cumsum(keep)])
            v, s, e = v[keep], at[s], at[e]
        p, q = _power(len(v) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * p[:-1], dtype=np.uint64)])
        out[k : k + n] = mix((total[e] - total[s]) * q[s] + (e - s).astype(np.uint64))
        k += n
    return out


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE * 2) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``most`` bytes of text in column 1, one row at least."""
    for b in batches:
        at = 0
        if not b.num_rows:
            continue
        _, offsets = buffers(b.column(1))
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield b.slice(at, to - at)
            at = to


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``flat[s : s + n]`` for each start and length."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class Store:
    """Ids of words by the words' hashes, kept between batches and started anew beyond ``most`` words.

    A table with two places for each hash finds a known word with one or two reads; a word that finds both taken takes the
    second, and the one it displaces is solved again when it comes again. Words are told apart by 64 bits of hash: among the
    ``most`` words of a store two of them agree with a chance of ``most ** 2 / 2 ** 65``, 1 in 30 million at a million words.
    """

    def __init__(self, most: int):
        self.most = most
        self.bits = max(10, int(4 * most - 1).bit_length())
        self._clear()

    def _clear(self) -> None:
        self.keys, self.entry = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.starts, self.lengths, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def ids(self, word: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray, solve) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words with these hashes and spans, and each word's number of ids. ``solve`` takes the bytes of new
        words and their places among all, and returns their flat ids and numbers."""
        if len(self.starts) > self.most:
            self._clear()
        word = np.maximum(word, np.uint64(1))  # 0 is a free place
        one, two = (word >> np.uint64(64 - self.bits)).astype(np.int64), (word & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        slot = np.where(self.keys[one] == word, one, two)
        of = self.entry[slot].astype(np.int64)
        miss = np.flatnonzero(self.keys[slot] != word)
        if len(miss):
            distinct, first, back = np.unique(word[miss], return_index=True, return_inverse=True)
            pick = miss[first]
            raw = data.tobytes()
            ids, n = solve([raw[a:b] for a, b in zip(s[pick].tolist(), e[pick].tolist(), strict=True)], pick)
            fresh = len(self.starts) + np.arange(len(distinct))
            of[miss] = fresh[back]
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(n) - n])
            self.lengths, self.flat = np.concatenate([self.lengths, n]), np.concatenate([self.flat, ids.astype(np.int32)])
            place = np.where(self.keys[one[pick]] == 0, one[pick], two[pick])
            place, kept = np.unique(place, return_index=True)  # of new words that meet in one place one takes it
            self.keys[place], self.entry[place] = distinct[kept], fresh[kept]
        return gather(self.flat, self.starts[of], self.lengths[of]), self.lengths[of]
