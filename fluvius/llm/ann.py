"""Approximate nearest neighbours by additive quantisation.

A vector is coded as one codeword from each of ``BOOKS`` full-dimensional codebooks, whose sum approximates it. Codebooks
are fitted on residuals of a bounded sample; a code is found by beam search over partial sums. With the squared norm of the
sum stored, a query's distance to every code is that norm minus twice the sum of ``BOOKS`` table entries. The ``RERANK`` best
codes of each block of rows are measured exactly on the original vectors, in double precision, before the k nearest of the
block are kept; so what leaves a task is k rows a query, however many rows it reads.

Every row is indexed and scored. Queries are worked off in blocks of ``QUERIES``, the only thing broadcast. Of vectors that
are equal, a block keeps the k + 1 with the smallest ids, which is all that can be among the k nearest (and the query itself).

Edge cases: vectors that are null, zero, or hold a null or non-finite component take no part, nor do those of another size
than most of the sample; ids may repeat (each row is a candidate, none of the query's own id); rows with a null id take no
part; fewer candidates than k are all returned; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluvius.session import write_table

SAMPLE = 16_384  # bound of the rows that codebooks are fitted on
BOOKS, WORDS, BEAM = 10, 256, 4
RERANK = 256
QUERIES = 8192
_PART = 4096  # rows coded or scored at once


def valid(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


class Quantiser:
    def __init__(self, books: np.ndarray):
        self.books = books  # (books, words, dims)
        self.square = (books.astype(np.float64) ** 2).sum(2).astype(np.float32)

    @classmethod
    def fit(cls, x: np.ndarray, seed: int = 7) -> Quantiser:
        """Codebooks by k-means on the residuals that the books before leave."""
        rng, rest, books = np.random.default_rng(seed), x.astype(np.float32).copy(), []
        k = min(WORDS, len(x))
        for _ in range(BOOKS):
            words = rest[rng.choice(len(rest), k, replace=False)].copy()
            for _ in range(8):
                near = cls._nearest(rest, words)
                count = np.bincount(near, minlength=k)
                total = np.zeros_like(words)
                np.add.at(total, near, rest)
                words = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], rest[rng.choice(len(rest), k)])
            rest -= words[cls._nearest(rest, words)]
            books.append(words)
        return cls(np.stack(books))

    @staticmethod
    def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
        square = (words**2).sum(1)
        return np.concatenate([np.argmin(square - 2 * (x[i : i + _PART] @ words.T), axis=1) for i in range(0, len(x), _PART)])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, books) and squared norms of the decoded vectors, by beam search."""
        codes, norms = [], []
        for at in range(0, len(x), _PART):
            rest = x[at : at + _PART].astype(np.float32)[:, None, :]  # (n, beams, dims): what is left to code
            code = np.zeros((len(rest), 1, 0), np.uint8)
            for b, words in enumerate(self.books):
                cost = (rest**2).sum(2)[:, :, None] + self.square[b] - 2 * (rest @ words.T)
                n, beams, k = cost.shape
                flat = cost.reshape(n, -1)
                keep = min(BEAM, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
                beam, word = best // k, best % k
                rest = np.take_along_axis(rest, beam[:, :, None], 1) - words[word]
                code = np.concatenate([np.take_along_axis(code, beam[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
            codes.append(code[:, 0])
            norms.append(((x[at : at + _PART] - rest[:, 0]) ** 2).sum(1).astype(np.float32))
        return np.concatenate(codes), np.concatenate(norms)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(books, queries, words): inner products of queries and codewords."""
        return np.stack([q.astype(np.float32) @ words.T for words in self.books])


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def index(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, Quantiser | None, int]:
    """(vec_id, code, norm, vector) of every valid row, as a table in the shared folder; the quantiser; the dimension."""
    good = rows.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vector")).where(F.col("vec_id").isNotNull() & valid(F.col("vector")))
    got = [r.vector for r in good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]
    sizes, counts = np.unique([len(v) for v in got], return_counts=True)
    if not len(sizes):
        return good.select("vec_id", F.lit(b"").alias("code"), F.lit(0.0).cast("float").alias("norm"), F.col("vector").cast("array<double>").alias("vector")), None, 0
    dims = int(sizes[np.argmax(counts)])
    quantiser = Quantiser.fit(np.array([v for v in got if len(v) == dims]))
    sent = rows.sparkSession.sparkContext.broadcast(quantiser)
    good = good.where(F.size("vector") == dims).select("vec_id", F.col("vector").cast("array<double>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                code, norm = sent.value.encode(_matrix(b.column(1), dims))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm), b.column(1)], ["vec_id", "code", "norm", "vector"])

    coded = good.mapInArrow(run, f"vec_id {good.schema['vec_id'].dataType.simpleString()}, code binary, norm float, vector array<double>")
    return write_table(coded, "ann-index"), quantiser, dims


def _distinct(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Rows of a block without those that equal ``most`` others of smaller id."""
    order = np.lexsort((ids, *x.T[:2]))
    _, same = np.unique(x, axis=0, return_inverse=True)
    order = np.lexsort((ids, same))
    group = same[order]
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    place = np.arange(len(order)) - np.repeat(begin, np.diff(np.r_[begin, len(order)]))
    return np.sort(order[place < most])


def _searcher(sent, k: int, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser, q_ids, q = sent.value
        tables = quantiser.tables(q)
        best_d, best_i = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        for b in batches:
            for at in range(0, b.num_rows, _PART):
                part = b.slice(at, _PART)
                ids, x = part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(3), dims)
                code = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(len(ids), -1)
                norm = part.column(2).to_numpy(zero_copy_only=False)
                keep = _distinct(ids, x, k + 1)
                ids, x, code, norm = ids[keep], x[keep], code[keep], norm[keep]
                top = min(RERANK + k, len(ids))
                for first in range(0, len(q), 256):
                    rows = slice(first, first + 256)
                    near = norm - 2 * reduce(np.add, (t[rows][:, code[:, m]] for m, t in enumerate(tables)))
                    found = np.argpartition(near, top - 1, axis=1)[:, :top]
                    for j, cand in enumerate(found, first):
                        cand = cand[ids[cand] != q_ids[j]]
                        d = np.sqrt(((x[cand] - q[j]) ** 2).sum(1))
                        d, i = np.concatenate([best_d[j], d]), np.concatenate([best_i[j], ids[cand]])
                        order = np.lexsort((i, d))[:k]
                        best_d[j], best_i[j] = d[order], i[order]
        row, col = np.nonzero(np.isfinite(best_d))
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(best_i[row, col]), pa.array(best_d[row, col])], ["query_id", "vec_id", "score"])

    return run


def search(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): the ``k`` nearest rows of each query other than itself."""
    spark = rows.sparkSession
    schema = "query_id long, vec_id long, score double"
    table, quantiser, dims = index(rows.select(F.col(id_col).cast("long").alias(id_col), vec_col), id_col, vec_col)
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).cast("array<double>").alias("q")).where(F.col("query_id").isNotNull() & valid(F.col("q")) & (F.size("q") == dims)).distinct()
    if quantiser is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = write_table(asked, "ann-queries")
    blocks, out = -(-asked.count() // QUERIES), []
    part = F.pmod(F.xxhash64("query_id", "q"), F.lit(2 * blocks)) if blocks > 1 else F.lit(0)
    for block in range(2 * blocks if blocks > 1 else blocks):
        got = asked.where(part == block).orderBy("query_id").collect()
        if got:
            sent = spark.sparkContext.broadcast((quantiser, np.array([r.query_id for r in got], np.int64), np.array([r.q for r in got], np.float64)))
            found = table.mapInArrow(_searcher(sent, k, dims), schema)
            out.append(write_table(found, "ann-block") if blocks > 1 else found)
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return reduce(DataFrame.unionAll, out).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
