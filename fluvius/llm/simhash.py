"""SimHash near-duplicates: 64-bit fingerprints, linked at 3 or fewer differing bits, and their connected groups.

Linking embeds a fingerprint as its 32 counts of set bits per 2-bit segment. A differing bit changes one count by one, so
the Manhattan distance of the counts is a lower bound of the Hamming distance. The counts are dealt into 6 blocks; a
distance of at most 3 touches at most 3 of them, so two linked fingerprints agree on all counts of at least 3 blocks: each
choice of 3 blocks and their counts is a cell of a grid, and a range join of radius 3 is an equality join on cells. Pairs
within a cell pass the Manhattan bound, then the exact distance. The search is complete: no link is lost.

Scale: equal fingerprints are one row before anything is linked. A cell is worked off by a sorted scan that emits a
spanning forest of its links, not all pairs. A cell with more than ``CELL`` fingerprints is dealt into blocks, and each pair
of blocks is a task of its own of bounded size. Groups come from distributed components over written tables.

Edge cases: null and empty texts have fingerprint zero, linked like any other; repeated rows are returned as often as they
come; a row with a null id gets its group's smallest id (null if the group has none); other columns are ignored. ``deduplicate``
keeps rows with a null id, and one row of those that share an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvius.operators.graph import components
from fluvius.session import write_table

WORDS = 3
RADIUS = 3
SEED = 42
CELL = 4096
#: Segments (2 bits each) of the six blocks.
BLOCKS = (6, 6, 5, 5, 5, 5)
_PART = 1 << 15  # shingles whose bits are unpacked at once


def fingerprint(text: bytes) -> int:
    """The fingerprint of a UTF-8 text."""
    words = text.lower().split()  # of bytes: A-Z, and the six ASCII white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(WORDS, len(words)) - 1
    starts, ends = starts[: len(words) - k].tolist(), ends[k:].tolist()
    of = xxhash.xxh64_intdigest
    n, counts = len(starts), np.zeros(64, np.int64)
    for at in range(0, n, _PART):
        h = np.array([of(joined[s:e], SEED) for s, e in zip(starts[at : at + _PART], ends[at : at + _PART], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of an Arrow column, null as empty, without making strings."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :].tolist()
    data = memoryview(column.buffers()[2] or b"")
    valid = column.is_valid().to_pylist() if column.null_count else None
    for i in range(len(column)):
        yield bytes(data[offsets[i] : offsets[i + 1]]) if valid is None or valid[i] else b""


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter(map(fingerprint, texts_of(b.column(1))), np.uint64, b.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a long."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprint_batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


_EVEN = 0x5555555555555555


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embed(fp: Column) -> Column:
    """The 32 two-bit counts, packed in a long."""
    low, high = fp.bitwiseAND(F.lit(_EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_EVEN))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))  # one set bit: 01, two: 10


def _cells(fps: DataFrame) -> DataFrame:
    """(cell, fp): the 20 grid cells of each fingerprint."""
    masks, at = [], 0
    for n in BLOCKS:
        masks.append(((1 << 2 * n) - 1) << at)
        at += 2 * n
    emb = F.col("emb")
    keys = [F.xxhash64(F.lit(i), emb.bitwiseAND(F.lit(_long(a | b | c)))) for i, (a, b, c) in enumerate(combinations(masks, 3))]
    return fps.select("fp", embed(F.col("fp")).alias("emb")).select("fp", F.explode(F.array(*keys)).alias("cell"))


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where fingerprints are within the radius: first by the Manhattan distance of their counts, then exactly."""
    even = np.uint64(_EVEN)
    one = np.uint64(1)
    x = ((a & even) + ((a >> one) & even)) ^ ((b & even) + ((b >> one) & even))
    low, high = x & even, (x >> one) & even
    bound = np.bitwise_count(low).astype(np.int16) + 2 * np.bitwise_count(high & ~low)
    out = bound <= RADIUS
    out[out] = np.bitwise_count((a ^ b)[out] if a.shape == b.shape else (np.broadcast_to(a, b.shape) ^ b)[out]) <= RADIUS
    return out


def _forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each linked fingerprint to the first of its component, by a search over those not yet reached."""
    left, src, dst = fp, [], []
    while len(left) > 1:
        root, left, queue = left[0], left[1:], [left[0]]
        while queue and len(left):
            hit = near(np.full(len(left), queue.pop()), left)
            if hit.any():
                src.append(left[hit])
                dst.append(np.full(int(hit.sum()), root))
                queue += list(left[hit])
                left = left[~hit]
    none = np.empty(0, np.uint64)
    return (np.concatenate(src), np.concatenate(dst)) if src else (none, none)


_SMALL = 12


def links(cell: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is linked within each run of equal cells."""
    begins = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[begins, len(cell)])
    src, dst = [], []
    small = np.repeat(sizes <= _SMALL, sizes)
    for d in range(1, _SMALL):
        i = np.flatnonzero(small[:-d] & (cell[:-d] == cell[d:])) if len(cell) > d else np.empty(0, int)
        if not len(i):
            break
        hit = i[near(fp[i], fp[i + d])]
        src.append(fp[hit + d])
        dst.append(fp[hit])
    for at, n in zip(begins[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist(), strict=True):
        s, t = _forest(fp[at : at + n])
        src.append(s)
        dst.append(t)
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *src]), np.concatenate([none, *dst])


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by cell; the last run of a batch is held back, as it may go on in the next. Runs are bounded, so is what is held."""
    cell, fp = np.empty(0, np.int64), np.empty(0, np.uint64)

    def out(n: int) -> pa.RecordBatch:
        s, t = links(cell[:n], fp[:n]) if n else (np.empty(0, np.uint64),) * 2
        pairs = np.unique(np.stack([s, t], 1), axis=0) if len(s) else np.empty((0, 2), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k]).view(np.int64)) for k in (0, 1)], ["src", "dst"])

    for b in batches:
        cell = np.concatenate([cell, b.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if len(cell) and len(cell) >= 50_000 and (n := int(np.searchsorted(cell, cell[-1]))):
            yield out(n)
            cell, fp = cell[n:], fp[n:]
    if len(cell):
        yield out(len(cell))


def link(fps: DataFrame) -> DataFrame:
    """(src, dst): edges between distinct fingerprints (fp) that connect exactly what links connect."""
    cells = _cells(fps)
    large = write_table(cells.groupBy("cell").count().where(F.col("count") > CELL), "large-cells")
    parts = F.ceil(F.col("count") / CELL).cast("int")
    rows = cells.join(large, "cell", "left")
    rows = rows.withColumn("part", F.when(F.col("count").isNotNull(), F.pmod(F.xxhash64("fp"), parts)))
    other = F.explode(F.when(F.col("count").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select("cell", "fp", "part", other.alias("other"))
    run = F.when(F.col("part").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", F.least("part", "other"), F.greatest("part", "other")))
    rows = rows.select(run.alias("cell"), "fp")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "cell").sortWithinPartitions("cell", "fp").mapInArrow(_link_batches, "src long, dst long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp, component_id (the smallest doc_id reachable over links)."""
    prints = write_table(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = write_table(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(link(fps))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: that with the smallest id. Of rows that share this id the one with the smallest
    hash of its text (then of the whole row) stays, one of those that are equal in both.

    Texts are not shuffled: the ids to go are joined, and of repeated ids only hashes move."""
    of = groups(docs, id_col, text_col).where("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = write_table(of, "gone")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    # the rows' own columns stay within a struct: none of their names can meet those of the joins
    key = F.col(f"_row.`{id_col}`")
    rows = docs.select(F.struct(*cols).alias("_row"), F.struct(F.xxhash64(F.col(f"`{text_col}`")).alias("a"), F.xxhash64(*_hashable(docs)).alias("b")).alias("_hash"))
    kept = rows.join(gone, key == F.col("_gone"), "left_anti")
    twice = docs.select(F.col(f"`{id_col}`").alias("_id")).where("_id is not null").groupBy("_id").count().where("count > 1").select("_id")
    twice = write_table(twice, "twice")
    if twice.isEmpty():
        return kept.select("_row.*")
    # of ids that come more than once only hashes are compared; rows left after that are equal, and one per id goes on from each task
    least = write_table(kept.join(twice, key == F.col("_id"), "left_semi").groupBy(key.alias("_id")).agg(F.min("_hash").alias("_least")), "least")
    one = kept.join(least, (key == F.col("_id")) & (F.col("_hash") == F.col("_least"))).dropDuplicates(["_id"])
    return kept.join(twice, key == F.col("_id"), "left_anti").select("_row.*").unionAll(one.select("_row.*"))


def _hashable(docs: DataFrame) -> list[Column]:
    """Every column as a value that can be hashed (maps as text)."""
    return [F.col(f"`{f.name}`") if not f.dataType.simpleString().count("map<") else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in docs.schema.fields]
