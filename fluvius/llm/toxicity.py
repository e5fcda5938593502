"""Toxicity: a linear classifier of texts whose training penalises score changes under swaps of identity terms.

Each labelled text is its set of hashed words and word beginnings (4 to 7 bytes, for inflected forms). A word takes part if its share of toxic texts is no chance (exact binomial
tail below ``CHANCE``): labels are noisy, and rare words would learn the noise. The loss is the logistic loss of the labels,
a small ridge, and for every sentence of a labelled text that names a group the squared change of the sentence's score when the
name is swapped for another of its kind: mentions of a group alone cannot raise or lower a score, however the labels fall.
At most ``SAMPLE`` labelled rows are learnt from. Scoring is one narrow pass with the weights broadcast (at most
``BUCKETS`` floats).

Edge cases: null and empty texts have no words and get the score of the intercept; repeated rows give repeated results;
without labelled rows of both labels every score is the labelled share (0 if none); a null id is not held out; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvius.llm import textkernel as K
from fluvius.llm.labelled import held_out, sample

SAMPLE = 8_000  # bound of the labelled rows learnt from
BUCKETS = 1 << 18
FOLD, REST = 3, 1
THRESHOLD = 0.7
RIDGE, SWAP = 0.02, 5.0
ROUNDS = 300
CHANCE = 1e-7
HEADS = (4, 5, 6, 7)

#: Identity terms by kind; a term is swapped for the others of its line (fixed values).
IDENTITY = (
    "muslim christian jewish hindu buddhist atheist catholic protestant",
    "muslims christians jews hindus buddhists atheists catholics protestants",
    "black white asian latino hispanic african european american arab",
    "women men girls boys", "woman man girl boy", "female male transgender nonbinary", "gay straight lesbian bisexual queer",
    "immigrants refugees foreigners natives", "immigrant refugee foreigner native", "disabled deaf blind autistic", "old young elderly",
    "femmes hommes", "musulmans chrétiens juifs", "noirs blancs", "frauen männer", "muslime christen juden", "mujeres hombres", "musulmanes cristianos judíos",
)


#: Bytes that end a sentence.
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def _hash(words: list[str]) -> np.ndarray:
    data, offsets = K.buffers(pa.array(words))
    s, e, _ = K.spans(data, offsets, K.WORD)
    return K.hashes(data, s, e, K.LOWER_TABLE)


GROUPS = [_hash(line.split()) for line in IDENTITY]
_ALL = np.concatenate(GROUPS)


def _bucket(word: np.ndarray) -> np.ndarray:
    return (word % np.uint64(BUCKETS)).astype(np.int64)


def terms_of(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, log2(1 + count)) of the distinct words and word beginnings of each text, sorted; only the ``wanted`` buckets, if given."""
    data, offsets = K.buffers(column)
    s, e, doc = K.spans(data, offsets, K.WORD)
    keys = []
    for n in (None, *HEADS):
        if n is None:
            word = K.hashes(data, s, e, K.LOWER_TABLE)
            long, b = np.arange(len(s)), _bucket(word)
        else:
            long = np.flatnonzero(e - s > n)
            b = _bucket(K.hashes(data, s[long], s[long] + n, K.LOWER_TABLE))
        if wanted is not None:
            long, b = long[wanted[b]], b[wanted[b]]
        if n is not None:  # identity terms count as wholes only, so that a swap moves one weight
            other = ~np.isin(word[long], _ALL)
            long, b = long[other], b[other]
        keys.append(doc[long] * BUCKETS + b)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return key // BUCKETS, key % BUCKETS, np.log2(1 + count).astype(np.float32)


def swaps_of(column: pa.Array) -> list[tuple[int, int, int, float, float]]:
    """(text, bucket of a term, bucket of the term put in its place, the values that a sentence of the text loses and gains) for
    every sentence with an identity term and each other term of its kind. All of a term's mentions in the sentence are swapped."""
    data, offsets = K.buffers(column)
    s, e, doc = K.spans(data, offsets, K.WORD)
    word = K.hashes(data, s, e, K.LOWER_TABLE)
    at = np.flatnonzero(np.isin(word, _ALL))
    sentence = np.cumsum(_STOP[data])[s[at]] if len(at) else at
    counts: dict[tuple[int, int], dict[int, int]] = {}
    for i, of in zip(at.tolist(), sentence.tolist(), strict=True):
        here = counts.setdefault((int(doc[i]), of), {})
        here[int(word[i])] = here.get(int(word[i]), 0) + 1
    out = []
    for (d, _), here in counts.items():
        for group in GROUPS:
            for gone in (w for w in group.tolist() if w in here):
                for come in (w for w in group.tolist() if w != gone):
                    k, m = here[gone], here.get(come, 0)
                    out.append((d, gone % BUCKETS, come % BUCKETS, float(np.log2(1 + k)), float(np.log2(1 + m + k) - np.log2(1 + m))))
    return out


def _tail(hits: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """log10 of the chance of ``hits`` or more among ``n`` at ``share`` (Chernoff's bound), 0 where hits are no more than expected."""
    q = hits / n
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = q * np.log(q / share) + np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - share)), 0)
    return np.where(q > share, -n * kl / np.log(10), 0.0)


class Model:
    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept
        self.wanted = weights != 0

    def score(self, column: pa.Array) -> np.ndarray:
        doc, b, x = terms_of(column, self.wanted)  # only words with a weight matter, so only they are counted
        return 1 / (1 + np.exp(-self.intercept - np.bincount(doc, weights=self.weights[b] * x, minlength=len(column))))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], swaps: list[tuple[int, int, float, float]]) -> Model:
    """Accelerated gradient descent. rows: buckets, values and label of each text; swaps: the bucket taken away, the one brought,
    and the values that go and come with them."""
    y = np.array([r[2] for r in rows])
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(BUCKETS), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    share = float(y.mean())
    df, hits = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, _, label in rows:
        df[b] += 1
        hits[b] += label
    some = np.flatnonzero(df)
    telling = (_tail(hits[some], df[some], share) < np.log10(CHANCE)) | (_tail(df[some] - hits[some], df[some], 1 - share) < np.log10(CHANCE))
    used = some[telling]
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    cols = [place[b][place[b] >= 0] for b, _, _ in rows]
    row, col, x = np.repeat(np.arange(len(rows)), [len(c) for c in cols]), np.concatenate(cols), np.concatenate([v[place[b] >= 0] for b, v, _ in rows])
    gone, come = (np.array([place[x[k]] for x in swaps], np.int64) for k in (0, 1))
    less, more = (np.array([x[k] for x in swaps]) for k in (2, 3))
    live = (gone >= 0) | (come >= 0)
    gone, come, less, more = gone[live], come[live], less[live], more[live]
    n, k, w, bias = len(rows), len(used), np.zeros(len(used) + 1), float(np.log(share / (1 - share)))
    # step sizes by column: a bound of the curvature of each weight; the last place stands for words without a weight
    length = np.bincount(row, weights=x, minlength=n) + 1.0
    curve = np.bincount(col, weights=0.25 * x * length[row], minlength=k + 1) + RIDGE + 4 * SWAP * (np.bincount(np.where(gone < 0, k, gone), weights=less**2, minlength=k + 1) + np.bincount(np.where(come < 0, k, come), weights=more**2, minlength=k + 1))
    v, vb, t = w.copy(), bias, 1.0
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-(np.bincount(row, weights=x * v[col], minlength=n) + vb)))
        g = np.bincount(col, weights=x * (p - y)[row], minlength=k + 1) + RIDGE * v
        moved = 2 * SWAP * (more * v[come] - less * v[gone])  # place -1 is the last, whose weight is 0
        g += np.bincount(np.where(come < 0, k, come), weights=moved * more, minlength=k + 1) - np.bincount(np.where(gone < 0, k, gone), weights=moved * less, minlength=k + 1)
        after, after_b = v - g / curve, vb - (p - y).sum() / (0.25 * length.sum())
        after[k] = 0
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = after + (t - 1) / u * (after - w), after_b + (t - 1) / u * (after_b - bias)
        w, bias, t = after, after_b, u
    full = np.zeros(BUCKETS)
    full[used] = w[:k]
    return Model(full, float(bias))


def _row_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in K.slices(batches):
        of, bucket, x = terms_of(b.column(1))
        cut = np.searchsorted(of, np.arange(b.num_rows + 1))
        swapped: dict[int, list] = {}
        for d, *swap in swaps_of(b.column(1)):
            swapped.setdefault(d, []).append([float(v) for v in swap])
        cuts = list(zip(cut[:-1], cut[1:], strict=True))
        rows, values = [bucket[s:e].astype(np.int32).tobytes() for s, e in cuts], [x[s:e].astype(np.float16).tobytes() for s, e in cuts]
        kind = pa.list_(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(rows, pa.binary()), pa.array(values, pa.binary()), pa.array([swapped.get(i, []) for i in range(b.num_rows)], kind), b.column(2)], ["id", "buckets", "counts", "swaps", "label"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from at most ``SAMPLE`` labelled rows; only their hashed words reach the driver."""
    rows = sample(docs, labels, "toxic", FOLD, REST, SAMPLE, id_col, text_col)
    got = rows.mapInArrow(_row_batches, "id string, buckets binary, counts binary, swaps array<array<double>>, label double").collect()
    got.sort(key=lambda r: (r.id, r.buckets))
    return train([(np.frombuffer(r.buckets, np.int32), np.frombuffer(r.counts, np.float16).astype(float), r.label) for r in got], [(int(g), int(c), less, more) for r in got for g, c, less, more in r.swaps])


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_scorer(docs, model), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out("doc_id", FOLD, REST).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _scorer(docs: DataFrame, model: Model):
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.score(b.column(1)))], ["doc_id", "score"])

    return run


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the texts scored as toxic, in one narrow pass; all columns stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    cols = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(sent.value.score(b.column(1)) < THRESHOLD))], ["row"])

    return rows.mapInArrow(run, rows.select("row").schema).select("row.*")
