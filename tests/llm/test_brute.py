"""Operators that SQL cannot express against plain Python versions of them, row by row."""

import random
import re
import re._parser as sre
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fluvius.llm import ann, labelled, licenses, pii, quality, simhash, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def strings(pattern):
    """All strings that a rule's pattern stands for."""

    def seq(tokens):
        outs = [""]
        for op, arg in tokens:
            op = str(op)
            options = {
                "LITERAL": lambda: [chr(arg)],
                "BRANCH": lambda: [x for b in arg[1] for x in seq(b)],
                "SUBPATTERN": lambda: seq(arg[3]),
                "MAX_REPEAT": lambda: ([""] if arg[0] == 0 else []) + seq(arg[2]),
                "IN": lambda: [chr(a) for _, a in arg],
            }[op]()
            outs = [o + x for o in outs for x in options]
        return outs

    return seq(sre.parse(pattern))


def test_every_rule_passes_its_own_gate():
    for label, _, _, word, pattern in licenses.RULES:
        if not pattern.startswith(licenses._GRANT):
            for x in strings(pattern):
                assert f" {word}" in f" {x} ", (label, x)


def detections(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    body = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)) + " "
    found = []
    for i, (label, prio, score, word, pattern) in enumerate(licenses.RULES):
        if f" {word}" in body:
            for m in re.finditer(f"(?<= )(?:{pattern})(?= )", body):
                start, end = body[: m.start()].count(" ") - 1, body[: m.end()].count(" ")
                found.append((start, -end, prio, i, label, score))
    kept = []
    for start, end, prio, i, label, score in sorted(found):
        if not any(p <= prio and e >= -end for _, e, p in ((s, -x, q) for s, x, q, *_ in sorted(found)[: sorted(found).index((start, end, prio, i, label, score))])):
            kept.append((label, start, -end, prio, score))
    return kept


def test_license_detections(spark, texts):
    rng = random.Random(1)
    samples = [rng.choice(strings(r[4])) for r in licenses.RULES if not r[4].startswith(licenses._GRANT)]
    more = {-i: " ".join(rng.choice([rng.choice(samples), "Licensed under the terms of", "or", "İK"]) for _ in range(12)) for i in range(1, 60)}
    df = spark.createDataFrame([*texts.items(), *more.items()], "doc_id long, text string")
    found = 0
    for r in licenses.scan(df).collect():
        want = detections((texts | more)[r.doc_id])
        assert [tuple(d) for d in r.detections] == want, r.doc_id
        found += len(want)
    assert found > 150


def mod97(s):
    compact = s.replace(" ", "")
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def added(t):
    """The method's own kinds."""
    out = []
    for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", t):
        if mod97(m[0]):
            out.append((m.start(), "iban", m.end()))
    numbers = list(re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", t))
    for m, after in zip(numbers, [*(x.start() for x in numbers[1:]), len(t)], strict=False):
        if not re.search(r"^(?:000|666|9)|-00-|-0000$", m[0]):
            near = (t[max(0, m.start() - 40) : m.start()] + " " + t[m.end() : min(m.end() + 40, after)]).lower()
            if re.search(r"ssn|social security|sozialversicherung|s[ée]curit[ée] sociale|seguro social", near):
                out.append((m.start(), "ssn", m.end()))
    return sorted(out)


MORE = {
    -1: "SSN 123-45-6789 and 123-45-6789, also 000-12-3456; IBAN GB82 WEST 1234 5698 7654 32, DE89370400440532013000 DE88370400440532013000",
    -2: "a@b.cd" * 400 + " +1 (555) 123-4567 é\U0001f600 " * 300,
    -3: "x" * 1023 + " me@example.org " + "é" * 2050 + " 4111 1111 1111 1111 +49 30 1234567" + "z" * 1024 + " 1.2.3.4",
}


def test_pii_method_kinds(spark, texts):
    df = spark.createDataFrame([*texts.items(), *MORE.items()], "doc_id long, text string")
    for r in pii.scan(df).collect():
        got = sorted((x.start, x.kind, x.end) for x in r.spans if x.kind in ("iban", "ssn"))
        assert got == added((texts | MORE)[r.doc_id])
    assert len(added(MORE[-1])) == 4


def test_mask(spark, texts):
    """Every stretch of overlapping spans becomes its first span's kind, all else stays."""
    df = spark.createDataFrame([*texts.items(), *MORE.items()], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.scan(df).collect()}
    for r in pii.mask(df).collect():
        t, out, at = (texts | MORE)[r.doc_id], [], 0
        for x in spans[r.doc_id]:
            if x.start >= at:
                out += [t[at : x.start], f"[{x.kind.upper()}]"]
            at = max(at, x.end)
        assert r.text == "".join(out) + t[at:]


def test_pii_of_a_text_of_many_spans_is_near_linear(spark):
    took = []
    for n in (5_000, 20_000):
        df = spark.createDataFrame([(1, " ".join(f"u{i}@host{i}.org" for i in range(n)))], "doc_id long, text string")
        began = time.time()
        assert pii.digest(pii.scan(df)).first().n_email == n
        assert pii.mask(df).first().text.count("[EMAIL]") == n
        took.append(time.time() - began)
    assert took[1] < 6 * took[0] + 3


def test_quality_votes():
    """Cosines and votes of the blocked product against loops."""
    rng = np.random.default_rng(2)
    terms = rng.standard_normal((quality.BUCKETS, 8)).astype(np.float32)
    vectors = rng.standard_normal((200, 8)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = rng.integers(0, 2, 200).astype(float)
    model = quality.Model(terms, vectors, labels)
    samples = [" ".join(f"word{rng.integers(40)}" for _ in range(rng.integers(0, 30))) for _ in range(700)] + [None, ""]
    column = pa.array(samples)
    got = model.score(column)
    d, b, w = quality.features(column)
    for i in range(len(samples)):
        x = sum((terms[k].astype(float) * v for k, v in zip(b[d == i], w[d == i], strict=True)), np.zeros(8))
        if not x.any():
            assert got[i] == pytest.approx(labels.mean())
            continue
        cosines = [float(np.dot(x, v) / np.linalg.norm(x)) for v in vectors.astype(float)]
        near = sorted(range(200), key=lambda k: -cosines[k])[: quality.NEIGHBOURS]
        weight = [max(cosines[k], 0) ** 8 for k in near]
        want = (sum(a * labels[k] for a, k in zip(weight, near, strict=True)) + 0.5 * labels.mean()) / (sum(weight) + 0.5)
        assert got[i] == pytest.approx(want, abs=2e-3)


def test_toxicity_minimises_its_objective():
    """Training ends at the minimum of the stated loss, whose penalty is the score change of each sentence under each swap."""
    rng = np.random.default_rng(3)
    lines = []
    for i in range(300):
        bad = i % 2
        group = str(rng.choice(["women", "men"], p=[0.85, 0.15] if bad else [0.15, 0.85]))
        lines.append((f"The {group} and {group} are {'idiots' if bad else 'fine'}. Some {rng.choice(['girls', 'boys'])} play w{rng.integers(9)}!", float(bad)))
    rows, swaps, by_text = [], [], []
    for text, label in lines:
        _, b, x = toxicity.terms_of(pa.array([text]))
        rows.append((b, x.astype(float), label))
        here = toxicity.swaps_of(pa.array([text]))
        swaps += [s[1:] for s in here]
        by_text.append(here)
    m = toxicity.train(rows, swaps)

    def brute(text):  # the change of a sentence's score when every mention of a name is put as another
        kinds = [line.split() for line in toxicity.IDENTITY]
        score = lambda words: sum(m.weights[b] * x for b, x in zip(*toxicity.terms_of(pa.array([" ".join(words)]))[1:], strict=True))
        out = []
        for sentence in re.split(r"[.!?\n]", text):
            words = re.findall(r"\w+", sentence.lower())
            plain = [w for w in words if any(w in k for k in kinds)]
            for k in kinds:
                for gone in {w for w in plain if w in k}:
                    out += [score([come if w == gone else w for w in plain]) - score(plain) for come in k if come != gone]
        return sorted(out)

    for (text, _), here in list(zip(lines, by_text, strict=True))[:20]:
        got = sorted(more * m.weights[c] - less * m.weights[g] for _, g, c, less, more in here)
        assert np.allclose(got, brute(text), atol=1e-6)

    def loss(weights, bias):
        out = toxicity.RIDGE / 2 * (weights**2).sum() + toxicity.SWAP * sum((more * weights[c] - less * weights[g]) ** 2 for g, c, less, more in swaps)
        for b, x, y in rows:
            z = (weights[b] * x).sum() + bias
            out += np.log1p(np.exp(-z if y else z))
        return out

    best, used = loss(m.weights, m.intercept), np.flatnonzero(m.weights)
    for _ in range(20):
        step = np.zeros_like(m.weights)
        step[used] = rng.standard_normal(len(used)) * 0.03
        assert loss(m.weights + step, m.intercept + rng.standard_normal() * 0.03) >= best - 1e-6


def test_reject_and_deduplicate(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    model = toxicity.fit(docs, labels)
    bad = {d for d, t in texts.items() if model.score(pa.array([t]))[0] >= toxicity.THRESHOLD}
    assert bad and {r.doc_id for r in toxicity.reject(docs, model).collect()} == set(texts) - bad
    repeated = docs.unionAll(docs.where("doc_id % 3 = 0").withColumn("text", F.concat(F.col("text"), F.lit(" and more")))).unionAll(docs.limit(20))
    groups = {}
    for r in simhash.groups(repeated).collect():
        groups.setdefault(r.component_id, set()).add(r.doc_id)
    kept = simhash.deduplicate(repeated).collect()
    assert sorted(r.doc_id for r in kept) == sorted(groups)
    again = simhash.deduplicate(repeated.repartition(5)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, kept), key=repr)


def test_sample_is_bounded(spark):
    df = spark.range(3000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 50).cast("string")).alias("text"))
    labels = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    assert labelled.sample(df, labels, "quality", 5, 9, 100).count() == 1


def test_nearest_recall_on_many_vectors(spark):
    rng = np.random.default_rng(4)
    n, dim = 20_000, 32
    v = rng.standard_normal((n, dim)) * np.linspace(2, 0.3, dim)
    df = spark.createDataFrame([(2 * i, x) for i, x in enumerate(v.astype(np.float32).tolist())], "vec_id long, embedding array<float>")
    got = ann.search(df, df.where("vec_id % 1000 = 0")).toPandas()
    v, hits = v.astype(np.float32).astype(float), []
    for q in range(0, n, 500):
        d = ((v - v[q]) ** 2).sum(1)
        d[q] = np.inf
        hits.append(len(set(got[got.query_id == 2 * q].vec_id) & set((2 * np.argsort(d)[:10]).tolist())) / 10)
    assert np.mean(hits) >= 0.9
