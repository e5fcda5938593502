"""SentencePiece encoding and decoding by batched Viterbi in numpy.

The pieces of a model file are taken as they are (nothing is trained), and a text's segmentation is the one whose pieces have
the greatest sum of scores. A unigram file's scores are used as they stand. A file of merges has ranks instead: there the
piece of rank r gets the log probability that Zipf's law gives it, -log((r + 1) H). Of equal sums the one whose last piece is shorter, at each end. No piece
crosses from a word into the space that follows, nor any two neighbouring bytes that stand together in no piece: the text is
cut there, the parts (words, for short) are solved apart, each distinct one once as long as it is remembered. Equal-length words are rows of one matrix and advance together: the hash of every substring
comes from prefix hashes, is looked up among the sorted piece hashes, and a vectorised maximum over the piece lengths
stores score and back-pointer. Characters in no piece become their UTF-8 bytes' pieces, at a score below all others.

As in the file: white space is kept, a space is put before the text, nothing is normalised. U+2581 in a text is encoded as
bytes, so decoding gives every text back exactly, even one that is not valid UTF-8.

Edge cases: null and empty texts have no ids; repeated rows give repeated results; a null id is returned as it is; other
columns are ignored; texts are worked off in bounded slices, a longer text in one of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvius.llm import textkernel as K
from fluvius.llm.simhash import texts_of

_BASE = 0x100000001B3
_ROWS = 1 << 17  # cells of a matrix of words solved at once
_CACHE = 300_000  # distinct words kept between batches


class Pieces:
    """Sorted piece hashes with ids and scores; what executors get."""

    def __init__(self, names: list[str], scores: list[float], byte_ids: list[int], normal: list[int]):
        self.bytes = [b""] * len(names)
        self.longest = max((len(names[i]) for i in normal), default=1)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.r_[np.uint64(1), np.full(self.longest, _BASE, np.uint64)])
        texts = {i: names[i].replace("▁", " ") for i in normal}
        if any(" " in t.lstrip(" ") for t in texts.values()):
            raise ValueError("a piece holds a space after another character")
        for i, t in texts.items():
            self.bytes[i] = t.encode()
        for value, i in enumerate(byte_ids):
            self.bytes[i] = bytes([value])
        self.joint = np.zeros((256, 256), bool)  # bytes that stand together in a piece; those within a character always do
        self.joint[:, 128:192] = True
        for i in normal:
            raw = np.frombuffer(self.bytes[i], np.uint8)
            self.joint[raw[:-1], raw[1:]] = True
        keys = np.array([self._hash(t) for t in texts.values()], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(texts), np.int32)[order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces have one hash")
        self.scores = np.array([scores[i] for i in texts], np.float64)[order]
        self.bucket = np.searchsorted(self.keys, np.arange((1 << 18) + 1, dtype=np.uint64) << np.uint64(46)).astype(np.int32)
        self.bucket[-1] = len(self.keys)
        self.unknown = float(self.scores[self.scores > -1e8].min(initial=0)) - 10
        self.byte_ids = np.array(byte_ids, np.int32)

    def _hash(self, text: str) -> int:
        h = 0
        for c in text:
            h = (h * _BASE + ord(c) + 1) % (1 << 64)
        return int(K.mix(np.array([h + len(text) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        scores = [model.get_score(i) for i in range(n)]
        ranks = sorted(-scores[i] for i in normal if scores[i] > -1e8)
        if all(r == int(r) for r in ranks) and len(set(ranks)) == len(ranks):  # a file of merges
            total = float(sum(1 / (r + 1) for r in ranks))
            scores = [-float(np.log((1 - x) * total)) if -1e8 < x <= 0 else x for x in scores]
        return cls([model.id_to_piece(i) for i in range(n)], scores, byte_ids, normal)

    def solve(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, flat, and each word's number of ids."""
        texts = [w.decode("utf-8", "surrogateescape") for w in words]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order, flat, count = np.argsort(lengths, kind="stable"), [], []
        at = 0
        while at < len(order):
            n = int(lengths[order[at]])
            to = min(int(np.searchsorted(lengths[order], n, side="right")), at + max(1, _ROWS // max(n, 1)))
            ids, m = self._viterbi([texts[i] for i in order[at:to].tolist()], n)
            flat.append(ids)
            count.append(m)
            at = to
        flat, sizes = np.concatenate([np.empty(0, np.int32), *flat]), np.concatenate([np.empty(0, np.int64), *count])
        starts, numbers = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        starts[order], numbers[order] = np.cumsum(sizes) - sizes, sizes
        return K.gather(flat, starts, numbers), numbers

    def _probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where hashes are keys, and at which place of the sorted keys."""
        top = (h >> np.uint64(46)).astype(np.int32)
        at = self.bucket[top]
        some = np.flatnonzero(self.bucket[top + 1] > at)
        found = np.searchsorted(self.keys, h[some])
        found[found == len(self.keys)] = 0
        same = self.keys[found] == h[some]
        hit = np.zeros(len(h), bool)
        hit[some[same]] = True
        at[some] = found
        at[~hit] = 0
        return hit, at

    def _viterbi(self, words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        m = len(words)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n)
        prefix = np.zeros((n + 1, m), np.uint64)
        base = np.uint64(_BASE)
        for i in range(n):
            prefix[i + 1] = prefix[i] * base + chars[:, i].astype(np.uint64) + np.uint64(1)
        best = np.zeros((n + 1, m))
        back = np.zeros((n + 1, m), np.uint8 if self.longest < 256 else np.int32)
        piece = np.zeros((n + 1, m), np.int32)
        for e in range(1, n + 1):
            k = np.arange(1, min(e, self.longest) + 1)
            h = prefix[e] - prefix[e - k] * self.power[k][:, None]
            h = K.mix(h + (k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None])
            hit, at = (x.reshape(h.shape) for x in self._probe(h.ravel()))
            total = np.where(hit, best[e - k] + self.scores[at], -np.inf)
            alone = ~hit[0]
            total[0, alone] = best[e - 1, alone] + self.unknown
            top = np.argmax(total, axis=0)
            col = np.arange(m)
            best[e] = total[top, col]
            back[e] = k[top]
            piece[e] = np.where(alone & (top == 0), -1, self.ids[at[top, col]])
        # all words step back together; an id is put at the end of its piece, -2 elsewhere
        marks = np.full((m, n + 1), -2, np.int32)
        end = np.full(m, n)
        while (live := np.flatnonzero(end > 0)).size:
            marks[live, end[live]] = piece[end[live], live]
            end[live] -= back[end[live], live]
        found, odd = marks[:, 1:], (marks == -1).any(axis=1)
        number = (found != -2).sum(axis=1)
        flat = found[found != -2]
        if odd.any():  # characters in no piece: their bytes take their places
            row, col = np.nonzero(found != -2)
            extra = [(i, self.byte_ids[list(words[row[i]][col[i]].encode("utf-8", "surrogateescape"))]) for i in np.flatnonzero(flat == -1).tolist()]
            size = np.ones(len(flat), np.int64)
            size[[i for i, _ in extra]] = [len(b) for _, b in extra]
            begin = np.cumsum(size) - size
            flat = np.repeat(flat, size)
            for i, b in extra:
                flat[begin[i] : begin[i] + len(b)] = b
            number = np.bincount(row, weights=size, minlength=m).astype(np.int64)
        return flat, number

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))[1:]


def encoder(pieces: Pieces):
    """A function from a text column to the flat ids of its texts and each text's number of ids; it remembers words."""
    store = K.Store(_CACHE)

    def encode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = K.buffers(column)
        some = np.flatnonzero(np.diff(offsets))  # a space is put before each text that is not empty
        data = np.insert(data, offsets[some], 32)
        offsets = offsets + np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(column), np.int64)
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = ~pieces.joint[data[:-1], data[1:]]
        cut[offsets] = True
        at = np.flatnonzero(cut)
        s, e = at[:-1], at[1:]
        ids, n = store.ids(K.hashes(data, s, e, K.BYTE_TABLE), data, s, e, lambda words, _: pieces.solve(words))
        doc = np.searchsorted(offsets, s, side="right") - 1
        return ids, np.bincount(doc, weights=n, minlength=len(column)).astype(np.int64)

    return encode


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows, rows.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", checked: bool = False) -> DataFrame:
    """doc_id, ids array<int>, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of each row;
    with ``checked`` also ``exact``: whether decoding gives the text back."""
    pieces = Pieces.load(path)
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    rows, kind = _rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(sent.value)
        for b in K.slices(batches):
            flat, n = to_ids(b.column(1))
            ends = np.cumsum(n)
            ids = [flat[s:e] for s, e in zip((ends - n).tolist(), ends.tolist(), strict=True)]
            cols = [b.column(0), pa.ListArray.from_arrays(np.r_[0, ends].astype(np.int32), flat), pa.array(n), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
            if checked:
                cols.append(pa.array([sent.value.decode(x.tolist()) == t for x, t in zip(ids, texts_of(b.column(1)), strict=True)]))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "n_tokens", "ids_crc32", "exact"][: len(cols)])

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens long, ids_crc32 long" + ", exact boolean" * checked)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows of ids; null ids are an empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(Pieces.load(path))
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [sent.value.decode(x) if x else b"" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.decode("utf-8", "replace") for t in texts])], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
