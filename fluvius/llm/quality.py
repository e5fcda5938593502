"""Quality by nearest-neighbour voting among labelled texts in a latent-semantic space.

A text's terms are hashed: shapes of its white-space chunks (``ONE,!!`` is ``A,!``) alone and in pairs, its words, and for
chunks that occur in it again how often. Weights are (1 + log count) times the inverse document frequency over the labelled
sample; a truncated singular value decomposition of the sample gives the latent space. The sample's vectors and labels are
the only thing broadcast: at most ``SAMPLE`` rows of ``DIMS`` floats. Every text's vector is multiplied with all of them in
blocks (exact cosines), and the ``NEIGHBOURS`` nearest vote with weights that grow with the similarity.

Edge cases: null and empty texts have a zero vector and get the labelled share of 1; repeated rows give repeated results;
without any labelled row every score is 0.5; a null id is not held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvius.llm import textkernel as K
from fluvius.llm.labelled import held_out, sample

SAMPLE = 6000  # bound of the labelled rows learnt from
BUCKETS = 1 << 14
DIMS = 48
NEIGHBOURS = 40
FOLD, REST = 5, 0
THRESHOLD = 0.3


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, weight before idf) of each distinct term of each text, sorted by text and bucket."""
    data, offsets = K.buffers(column)
    n = len(offsets) - 1
    s, e, doc = K.spans(data, offsets, K.NOT_SPACE)
    if not len(s):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    shape = K.hashes(data, s, e, K.SHAPE_TABLE, collapse=True)
    word = K.hashes(data, s, e, K.LOWER_TABLE)
    same = doc[1:] == doc[:-1]
    pair = K.mix(shape[:-1] * np.uint64(3) + shape[1:])[same]
    again = (word[1:] == word[:-1]) & same
    quarter = np.uint64(BUCKETS // 4)
    # a quarter of the buckets for each kind of term
    bucket = np.concatenate([shape % quarter, quarter + pair % quarter, np.uint64(2) * quarter + word % (quarter * np.uint64(2) - np.uint64(1))]).astype(np.int64)
    of = np.concatenate([doc, doc[1:][same], doc])
    key = np.concatenate([of * BUCKETS + bucket, doc[1:][again] * BUCKETS + BUCKETS - 1])
    key, count = np.unique(key, return_counts=True)
    words = np.bincount(doc, minlength=n)
    d, b = key // BUCKETS, key % BUCKETS
    # shares of the text, so that length alone does not place it
    weight = np.log1p(1000.0 * count / words[d]).astype(np.float32)
    weight[b >= BUCKETS // 2] *= 0.35
    weight[b == BUCKETS - 1] *= 4
    return d, b, weight


class Model:
    """idf-weighted term vectors, and the sample's latent vectors and labels."""

    def __init__(self, terms: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.terms, self.vectors, self.labels = terms, vectors, labels
        self.prior = float(labels.mean()) if len(labels) else 0.5

    def project(self, column: pa.Array) -> np.ndarray:
        d, b, w = features(column)
        out = np.zeros((len(column), self.terms.shape[1]), np.float32)
        for at in range(0, len(d), 1 << 16):
            to = at + (1 << 16)
            rows, begins = np.unique(d[at:to], return_index=True)
            out[rows] += np.add.reduceat(self.terms[b[at:to]] * w[at:to, None], begins, axis=0)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    def score(self, column: pa.Array) -> np.ndarray:
        x = self.project(column)
        out = np.full(len(x), self.prior)
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(x) if k else 0, 512):
            block = x[at : at + 512]
            cosines = block @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** 8
            total = weight.sum(1)
            vote = (weight * self.labels[near]).sum(1)
            # the prior votes too, as half a neighbour
            out[at : at + 512] = np.where(total > 0, (vote + 0.5 * self.prior) / (total + 0.5), self.prior)
        return out


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in K.slices(batches):
        d, bucket, w = features(b.column(1))
        cut = np.searchsorted(d, np.arange(b.num_rows + 1))
        rows = [(bucket[x:y].astype(np.int32).tobytes(), w[x:y].tobytes()) for x, y in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), b.column(2)], ["id", "buckets", "weights", "label"])


def _svd(rows: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    """The leading right singular vectors of the sample's weighted term matrix, by subspace iteration on its sparse rows."""
    rng = np.random.default_rng(5)
    used = np.flatnonzero(idf)
    place = np.zeros(BUCKETS, np.int64)
    place[used] = np.arange(len(used))
    k = min(DIMS + 8, len(used), len(rows))
    basis = rng.standard_normal((len(used), k)).astype(np.float32)
    made = []
    for b, w in rows:
        x = w * idf[b]
        norm = np.linalg.norm(x)
        made.append((place[b], (x / norm if norm else x).astype(np.float32)))
    for _ in range(6):
        basis, _ = np.linalg.qr(basis)
        after = np.zeros_like(basis)
        for b, x in made:
            after[b] += x[:, None] * (x @ basis[b])
        basis = after
    basis, _ = np.linalg.qr(basis)
    out = np.zeros((BUCKETS, min(DIMS, k)), np.float32)
    out[used] = basis[:, : min(DIMS, k)]
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from at most ``SAMPLE`` labelled rows; only their hashed terms reach the driver."""
    rows = sample(docs, labels, "quality", FOLD, REST, SAMPLE, id_col, text_col)
    got = rows.mapInArrow(_feature_batches, "id string, buckets binary, weights binary, label double").collect()
    got.sort(key=lambda r: (r.id, r.buckets, r.weights))
    sparse = [(np.frombuffer(r.buckets, np.int32), np.frombuffer(r.weights, np.float32)) for r in got]
    df = np.zeros(BUCKETS)
    for b, _ in sparse:
        df[b] += 1
    idf = np.where(df >= 2, np.log((1 + len(sparse)) / (1 + df)) + 0.1, 0).astype(np.float32)
    if not idf.any():
        return Model(np.zeros((BUCKETS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    terms = _svd(sparse, idf) * idf[:, None]
    vectors = np.stack([w @ terms[b] for b, w in sparse])
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Model(terms, vectors / np.where(norm > 0, norm, 1), np.array([r.label for r in got]))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.score(b.column(1)))], ["doc_id", "score"])

    out = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out("doc_id", FOLD, REST).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
