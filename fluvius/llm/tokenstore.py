"""Token ids in wavelet-matrix files.

A shard file holds the ids of consecutive documents as a wavelet matrix: one plane of bits for each binary digit of an id,
each plane stably sorted by the digits above it. Rank and select on the planes answer access, counting and occurrence
queries without unpacking the ids. Planes are cut into blocks, each compressed on its own, with the number of ones before
each block in the header, so a query reads a few blocks of the one file.

File: ``FLWM2\\n``, the header's length (8 bytes little-endian), a JSON header (n, planes, zeros of each plane, blocks of a
plane, documents, and the sizes of the parts that follow), then the directory, the documents' ids as an Arrow stream, and
the blocks (zlib). The directory holds, as little-endian int64, the offset and compressed size of every block and the ones
before it within its plane, and the documents' lengths.

Writing: documents are range-partitioned by id into shards; a task encodes its shard and writes one file under the shared
folder, under a temporary name that is renamed when complete, so a task that runs again does no harm. The manifest is a table
with a row for each shard, numbered by its range. Encoding cuts a text where the tokenizer's own pre-tokenizer must cut, and
gives each distinct part to the tokenizers library once, many to a call; texts that hold the string of an added token are
given to it whole.

Edge cases: null and empty texts are one end id; repeated ids keep all their rows, ordered by their texts' hashes; a null id comes
first; an empty table gives no file and no rows; other columns are ignored.
"""

from __future__ import annotations

import io
import itertools
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluvius.llm import textkernel as K
from fluvius.session import shared_path, write_table

END = 1  # id appended to each document
MAGIC = b"FLWM2\n"
BLOCK = 1 << 16  # bits of a plane compressed together
SHARD_BYTES = 24 << 20  # text of a shard, about
_CACHE = 1_000_000
_JOINED = 50  # words given to the library in one text


class WaveletMatrix:
    """Rank, select and access on the planes of one file."""

    def __init__(self, header: dict, read):
        """``read(offset, size)`` returns bytes of the file's parts."""
        self.n, self.planes, self.zeros = header["n"], header["planes"], header["zeros"]
        self.header, self._read, self._kept = header, read, {}
        blocks = header["blocks"]
        directory = np.frombuffer(read(0, header["directory"]), "<i8")
        self.at, self.size, self.ones = (x.reshape(self.planes, blocks) for x in np.split(directory[: 3 * self.planes * blocks], 3))
        self.lengths = directory[3 * self.planes * blocks :]
        self._base = header["directory"] + header["ids"]

    @classmethod
    def open(cls, raw: bytes) -> WaveletMatrix:
        return cls.over(io.BytesIO(raw))

    @classmethod
    def over(cls, f) -> WaveletMatrix:
        """Of a seekable file."""
        f.seek(0)
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        size = int.from_bytes(f.read(8), "little")
        header = json.loads(f.read(size))
        base = len(MAGIC) + 8 + size

        def read(offset: int, n: int) -> bytes:
            f.seek(base + offset)
            return f.read(n)

        return cls(header, read)

    def ids(self) -> pa.Array:
        """The documents' ids, in order."""
        return pa.ipc.open_stream(self._read(self.header["directory"], self.header["ids"])).read_all().column(0).combine_chunks()

    def _block(self, plane: int, block: int) -> np.ndarray:
        """The bytes of a block, lowest bit first."""
        key = (plane, block)
        if key not in self._kept:
            if len(self._kept) > 256:
                self._kept.clear()
            self._kept[key] = np.frombuffer(zlib.decompress(self._read(self._base + int(self.at[key]), int(self.size[key]))), np.uint8)
        return self._kept[key]

    def bit(self, plane: int, i: int) -> int:
        return int(self._block(plane, i // BLOCK)[i % BLOCK >> 3]) >> (i & 7) & 1

    def rank(self, plane: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane: those before the block, of whole bytes in it, and of the last byte's bits."""
        if i >= self.n:
            return self.n - self.zeros[plane]
        raw, at = self._block(plane, i // BLOCK), i % BLOCK
        return int(self.ones[plane, i // BLOCK]) + int(np.bitwise_count(raw[: at >> 3]).sum(dtype=np.int64)) + (int(raw[at >> 3]) & (1 << (at & 7)) - 1).bit_count()

    def select(self, plane: int, bit: int, k: int) -> int:
        """Place of the ``k``-th (from 0) bit of this value: the directory names the block, which alone is opened."""
        before = self.ones[plane] if bit else np.arange(len(self.ones[plane])) * BLOCK - self.ones[plane]
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self._block(plane, block), count=min(BLOCK, self.n - block * BLOCK), bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for p in range(self.planes):
            b, r = self.bit(p, i), self.rank(p, i)
            out = out << 1 | b
            i = self.zeros[p] + r if b else i - r
        return out

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often a token occurs in places [low, high)."""
        low, high = self._range(token, low, self.n if high is None else high)
        return high - low

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        if token >> self.planes:
            return 0, 0
        for p in range(self.planes):
            a, b = self.rank(p, low), self.rank(p, high)
            low, high = (self.zeros[p] + a, self.zeros[p] + b) if token >> (self.planes - 1 - p) & 1 else (low - a, high - b)
        return low, high

    def occurrence(self, token: int, k: int) -> int:
        """Place of the ``k``-th (from 0) occurrence of a token, -1 if there is none."""
        low, high = self._range(token, 0, self.n)
        if k < 0 or low + k >= high:
            return -1
        i = low + k
        for p in reversed(range(self.planes)):
            one = token >> (self.planes - 1 - p) & 1
            i = self.select(p, one, i - self.zeros[p] if one else i)
        return i

    def all(self) -> np.ndarray:
        """All ids: the planes are merged from the last up, block by block."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        low, up = np.zeros(self.n, kind), np.empty(self.n, kind)
        for p in reversed(range(self.planes)):
            z, o, top = 0, self.zeros[p], kind(1 << (self.planes - 1 - p))
            for block in range(self.header["blocks"]):
                part = up[block * BLOCK : (block + 1) * BLOCK]
                raw = zlib.decompress(self._read(self._base + int(self.at[p, block]), int(self.size[p, block])))
                on = np.unpackbits(np.frombuffer(raw, np.uint8), count=len(part), bitorder="little").view(bool)
                one, none = np.flatnonzero(on), np.flatnonzero(~on)
                part[none] = low[z : z + len(none)]
                part[one] = low[o : o + len(one)] | top
                z, o = z + len(none), o + len(one)
            low, up = up, low
        return low.astype(np.uint32)


def pack(ids: np.ndarray, lengths: np.ndarray, docs: pa.Array | None = None) -> bytes:
    """The file of a sequence of ids, of documents of these lengths and (if given) with these ids."""
    planes = max(1, int(ids.max(initial=0)).bit_length())
    kind = np.uint16 if planes <= 16 else np.uint32
    now, after = ids.astype(kind), np.empty(len(ids), kind)
    blocks = -(-len(ids) // BLOCK)
    at, size, ones = (np.zeros((planes, blocks), np.int64) for _ in range(3))
    body, zeros, end = [], [], 0
    for p in range(planes):
        shift = kind(planes - 1 - p)
        on = (now >> shift & kind(1)).astype(np.uint8)
        for block in range(blocks):
            raw = np.packbits(on[block * BLOCK : (block + 1) * BLOCK], bitorder="little")
            body.append(zlib.compress(raw, 1))
            at[p, block], size[p, block], ones[p, block] = end, len(body[-1]), np.bitwise_count(raw).sum(dtype=np.int64)
            end += len(body[-1])
        total = int(ones[p].sum())
        zeros.append(len(ids) - total)
        z, o = 0, zeros[-1]
        for block in range(blocks):  # a stable partition by the bit, in parts that stay in the processor's cache
            part, bit = now[block * BLOCK : (block + 1) * BLOCK], on[block * BLOCK : (block + 1) * BLOCK].view(bool)
            none, one = part.take(np.flatnonzero(~bit)), part.take(np.flatnonzero(bit))
            after[z : z + len(none)], after[o : o + len(one)] = none, one
            z, o = z + len(none), o + len(one)
        ones[p] = np.cumsum(ones[p]) - ones[p]
        now, after = after, now
    directory = b"".join(x.astype("<i8").tobytes() for x in (at, size, ones, lengths))
    sink = io.BytesIO()
    table = pa.table({"doc_id": pa.nulls(len(lengths)) if docs is None else docs})
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    header = {"n": len(ids), "planes": planes, "zeros": zeros, "blocks": blocks, "documents": len(lengths), "directory": len(directory), "ids": sink.tell()}
    raw = json.dumps(header, separators=(",", ":")).encode()
    return b"".join([MAGIC, len(raw).to_bytes(8, "little"), raw, directory, sink.getvalue(), *body])


#: Byte classes: letters (ASCII, and those of two-byte characters from U+00C0 to U+027F), marks that never join a letter, the rest.
_SPACE, _LETTER, _MARK, _OTHER = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[np.r_[65:91, 97:123, 0x80:0xC0, 0xC3:0xCA]] = _LETTER
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = _MARK
#: Two-byte characters in that range that are no letters, or whose lower case is not one letter: U+00D7, U+00F7, U+0130.
_ODD = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the parts that the pre-tokenizer of the word-level vocabulary treats apart (white-space chunks, and
    within chunks of plain letters and marks only, each run of either), whether a part is such a run, and where each text's
    parts begin (with the end)."""
    kind = _CLASS[data]
    for a, b in _ODD:
        kind[:-1][(data[:-1] == a) & (data[1:] == b)] = _OTHER
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    text = edge[:-1].copy()  # a text begins here
    edge[1:-1] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(edge[:-1])  # runs of one class
    of, first = kind[at], text[at]
    space = of == _SPACE
    chunk = ~space & (first | np.concatenate([[True], space[:-1]]))
    number = np.cumsum(chunk) - 1
    plain = np.ones(int(chunk.sum()), bool)
    plain[number[of == _OTHER]] = False
    begins = chunk | ~space & plain[number] if len(plain) else chunk
    stops = np.flatnonzero(begins | space)
    here = begins[stops]
    after = np.append(at[stops[1:]], len(data)) if len(stops) else at
    starts = at[stops[here]]
    return starts, after[here], plain[number[stops[here]]], np.searchsorted(starts, offsets)


def tokenizer_ids(path: str):
    """A function from a text column to flat ids and each text's number of ids, the end id included."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    special = [(t.content, t.normalized) for t in model.get_added_tokens_decoder().values()]
    store = K.Store(_CACHE)
    suffix = getattr(model.model, "end_of_word_suffix", None)
    last = np.zeros(model.get_vocab_size(), bool)  # ids that end a pre-tokenizer's word
    if suffix:
        last[[i for token, i in model.get_vocab(with_added_tokens=False).items() if token.endswith(suffix)]] = True

    def encode_all(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [x.ids for at in range(0, len(texts), 20_000) for x in model.encode_batch_fast(texts[at : at + 20_000], add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(itertools.chain.from_iterable(got), np.int32, int(n.sum())), n

    def solve(words: list[bytes], run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``run`` tells the words that are one run each: the library makes one word of it, whose last id has the suffix, so
        many go in one text."""
        runs, others = np.flatnonzero(run & bool(suffix)), np.flatnonzero(~(run & bool(suffix)))
        one, n_one = encode_all([b" ".join([words[i] for i in runs[at : at + _JOINED].tolist()]).decode("utf-8", "replace") for at in range(0, len(runs), _JOINED)])
        ends = np.flatnonzero(last[one]) + 1
        if len(ends) != len(runs):  # words that the library cuts otherwise: each on its own
            runs, others, one, ends = runs[:0], np.arange(len(words)), one[:0], ends[:0]
        two, n_two = encode_all([words[i].decode("utf-8", "replace") for i in others.tolist()])
        n, starts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        n[runs], n[others] = np.diff(ends, prepend=0), n_two
        starts[runs], starts[others] = ends - n[runs], len(one) + np.cumsum(n_two) - n_two
        return K.gather(np.concatenate([one, two]), starts, n), n

    def encode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # the library looks for added tokens before it cuts a text into parts: texts that hold one are given to it whole
        whole = np.zeros(len(column), bool)
        for content, any_case in special:
            whole |= pc.fill_null(pc.match_substring(column, content, ignore_case=any_case), False).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(whole)
        more = encode_all(column.take(pa.array(rows)).to_pylist()) if len(rows) else None
        if more:
            column = pc.if_else(pa.array(whole), pa.scalar(None, column.type), column)
        data, offsets = K.buffers(column)
        ids, per = np.empty(0, np.int32), np.zeros(len(column), np.int64)
        if len(data):
            s, e, run, of_text = parts(data, offsets)
            ids, n = store.ids(K.hashes(data, s, e, K.LOWER_TABLE), data, s, e, lambda words, pick: solve(words, run[pick]))
            per = np.diff(np.concatenate([[0], np.cumsum(n)])[of_text])
        if more:
            ids = np.insert(ids, np.repeat(np.cumsum(per)[rows], more[1]), more[0])
            per[rows] = more[1]
        return np.insert(ids, np.cumsum(per), END), per + 1

    return encode


_encoders: dict = {}  # by path, one per worker, so that words are remembered between tasks


def _encoder(path: str):
    if path not in _encoders:
        _encoders[path] = tokenizer_ids(path)
    return _encoders[path]


_MANIFEST = pa.schema([("file", pa.string()), ("shard", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64())])


def _writer(path: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by id; one file for all of the task's rows."""
        encode, ids, lengths, names = _encoder(path), [], [], []
        for b in K.slices(batches):
            flat, n = encode(b.column(1))
            ids.append(flat.astype(np.uint16) if flat.max() < 65536 else flat)
            lengths.append(n)
            names.append(b.column(0))
        if not ids:
            return
        n = np.concatenate(lengths)
        raw = pack(np.concatenate(ids), n, pa.concat_arrays(names))
        fs, at = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        name = f"{uuid.uuid4().hex}.flwm"
        with fs.open_output_stream(f"{at}/_{name}.part") as f:
            f.write(raw)
        fs.move(f"{at}/_{name}.part", f"{at}/{name}")
        yield pa.RecordBatch.from_pydict({"file": [name], "shard": [TaskContext.get().partitionId()], "docs": [len(n)], "tokens": [int(n.sum())]}, schema=_MANIFEST)

    return run


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Write shard files under a URI; (the URI, manifest): file, shard (its number in order of ids), docs, tokens, start (ids in
    the shards before it). Only files in the manifest count: others are left by tasks that were lost."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-size // SHARD_BYTES))
    # rows of one id and one hash are the same text, so order and shards are the same in every run but for the ranges' ends
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    done = write_table(rows.mapInArrow(_writer(tokenizer, folder), "file string, shard int, docs long, tokens long"), "manifest")
    # one row for each SHARD_BYTES of text: the running sum is the only step that sees all shards at once
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return folder, done.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read(spark: SparkSession, folder: str, manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, unpacked from the files that the manifest names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, at = pyarrow.fs.FileSystem.from_uri(f"{folder}/{name}")
                with fs.open_input_stream(at) as f:
                    m = WaveletMatrix.open(f.read())
                ids, docs = memoryview(m.all().astype("<u4")).cast("B"), m.ids()
                ends = np.cumsum(m.lengths)
                crc = [zlib.crc32(ids[4 * s : 4 * e]) for s, e in zip((ends - m.lengths).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([docs, pa.array(start + ends - m.lengths), pa.array(m.lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # each shard is a task's work: the few rows of the manifest are dealt out by themselves
    files = manifest.select("file", "start", "shard").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard").select("file", "start")
    return files.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")
