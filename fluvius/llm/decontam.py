"""Benchmark decontamination by spaced-seed hashing.

A mask such as ``1101011`` hashes the tokens at its 1s and ignores those at its 0s, so a hit survives substitutions there.
Every position of every document and of every benchmark item is hashed under each mask, equal hashes are joined, and for each
run of hits on one diagonal the document and the item are compared along the whole of it. The comparison gives the longest
segment that begins and ends with a word that agrees and of whose words ``MIN_SHARE`` agree. That is a leak if it has
``MIN_WORDS`` words; so is an item that lies wholly in the document with ``MIN_SHARE`` of its words.

Items of fewer than ``SPAN`` words hold no seed. They are leaks where all their words stand consecutively, found by an equality
join on the hashes of whole items of each length that occurs among them.

The documents are never shuffled and their positions never written: scan, hashing, probe and verification are one narrow
stage, in which the benchmark's seeds are the broadcast side. Their number is counted first; a benchmark with more than
``BLOCK_SEEDS`` seeds or item words is split into blocks of items of at most that many, each probed in its own pass.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.

Edge cases: null or empty texts have no words and no rows, as documents and as items; rows with the same id count as one
document; a null id is kept as an id of its own; other columns are ignored; texts of any length are compared whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvius.llm.licenses import SEPARATORS, lowered
from fluvius.session import write_table

MASKS = ("11101011", "11011101", "10110111")
SPAN = 8
MIN_WORDS, MIN_SHARE = 13, 0.8
MISS = 4  # MIN_SHARE as a score: 1 a word that agrees, -4 another, not below 0 in all
BLOCK_SEEDS = 1_000_000  # about 32 MB of broadcast rows
LEAST = 5  # words of an item that ``clean`` goes by


def _words(text: Column) -> Column:
    """The text's words as 64-bit hashes, on which all that follows works."""
    body = F.trim(F.regexp_replace(lowered(text), SEPARATORS, " "))
    return F.array_remove(F.transform(F.split(body, " "), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))


def _positions(df: DataFrame, *keep: str) -> DataFrame:
    """A row for each mask and position: keep, words, i, h."""
    at = df.select(*keep, "words", F.explode(F.when(F.size("words") >= SPAN, F.sequence(F.lit(0), F.size("words") - SPAN))).alias("i"))
    hashes = [F.xxhash64(F.lit(m), *[F.get("words", F.col("i") + o) for o, bit in enumerate(mask) if bit == "1"]) for m, mask in enumerate(MASKS)]
    return at.select(*keep, "words", "i", F.posexplode(F.array(*hashes)).alias("m", "h"))  # a mask's number is hashed too


def _same(a: str, i: Column, b: str, j: Column, mask: str) -> Column:
    return reduce(lambda x, y: x & y, [F.get(a, i + o).eqNullSafe(F.get(b, j + o)) for o, bit in enumerate(mask) if bit == "1"])


def _probe(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Verified segments of ``docs`` (doc_id, words) that lie in ``items`` (item_id, item), both sides with repeats."""
    seeds = _positions(items.withColumnRenamed("item", "words"), "item_id").select("item_id", F.col("i").alias("j"), "m", "h").distinct()
    hits = _positions(docs, "doc_id").drop("m").join(F.broadcast(seeds), "h").join(F.broadcast(items), "item_id")
    # of the hits that follow each other on a diagonal only the first is verified
    i, j = F.col("i"), F.col("j")
    again = (i > 0) & (j > 0) & reduce(lambda x, y: x | y, [(F.col("m") == m) & _same("words", i - 1, "item", j - 1, mask) for m, mask in enumerate(MASKS)])
    first = hits.where(~again)
    back = F.least(i, j)
    width = F.least(F.size("words") - i + back, F.size("item") - j + back)
    # only the words compared leave the probe: a generator keeps this apart from the projection that follows
    cut = F.struct((i - back).alias("at"), F.slice("words", i - back + 1, width).alias("a"), F.slice("item", j - back + 1, width).alias("b"))
    first = first.select("doc_id", "item_id", F.size("item").alias("item_words"), F.inline(F.array(cut)))
    seg = first.select("doc_id", "item_id", "at", "item_words", F.size("a").alias("width"), F.aggregate(F.zip_with("a", "b", lambda x, y: x == y), _zero(), _step).alias("s"))
    whole = (F.col("width") == F.col("item_words")) & (F.col("s.same") >= MIN_SHARE * F.col("width"))
    n, same = F.col("s.n"), ((F.col("s.sum") + MISS * F.col("s.n")) / (MISS + 1)).cast("int")
    return seg.where(whole | (n >= MIN_WORDS)).select(
        "doc_id", "item_id", "item_words", F.when(whole, F.col("at")).otherwise(F.col("at") + F.col("s.b")).alias("start_word"),
        F.when(whole, F.col("width")).otherwise(n).alias("n_words"), F.when(whole, F.col("s.same")).otherwise(same).alias("n_same"),
    )


_STARTS = "array<struct<k:int,score:int>>"
def _zero() -> Column:
    return F.struct(*[F.lit(0).alias(x) for x in ("k", "score", "same")], F.lit(False).alias("on"), F.array().cast(_STARTS).alias("starts"), *[F.lit(0).alias(x) for x in ("n", "b", "sum")])


def _step(a: Column, same: Column) -> Column:
    """One word more. ``starts`` are the places where words begin to agree at a lower score than at all such places before: the
    first of them whose score is not above the present one begins the longest segment that ends here."""
    score = a["score"] + F.when(same, 1).otherwise(-MISS)
    lower = same & ~a["on"] & ((F.size(a["starts"]) == 0) | (a["score"] < F.coalesce(F.get(a["starts"], F.size(a["starts"]) - 1)["score"], F.lit(0))))
    starts = F.when(lower, F.concat(a["starts"], F.array(F.struct(a["k"].alias("k"), a["score"].alias("score"))))).otherwise(a["starts"])
    begin = F.when(same, F.get(F.filter(starts, lambda x: x["score"] <= score), F.lit(0)))
    better = F.coalesce(same & (a["k"] + 1 - begin["k"] > a["n"]), F.lit(False))
    return F.struct(
        (a["k"] + 1).alias("k"), score.alias("score"), (a["same"] + same.cast("int")).alias("same"), same.alias("on"), starts.alias("starts"),
        F.when(better, a["k"] + 1 - begin["k"]).otherwise(a["n"]).alias("n"), F.when(better, begin["k"]).otherwise(a["b"]).alias("b"), F.when(better, score - begin["score"]).otherwise(a["sum"]).alias("sum"),
    )


def _short(docs: DataFrame, items: DataFrame, lengths: list[int]) -> DataFrame:
    """Places of whole items of these few lengths, each less than ``SPAN``."""

    def key(words: str, at: Column, n: int) -> Column:
        return F.xxhash64(F.lit(n), *[F.get(words, at + o) for o in range(n)])

    whole = items.select("item_id", "item", F.coalesce(*[F.when(F.size("item") == n, key("item", F.lit(0), n)) for n in lengths]).alias("h")).distinct()
    at = docs.select("doc_id", "words", F.explode(F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1))).alias("i"))
    rows = at.select("doc_id", "words", "i", F.explode(F.array(*[F.when(F.col("i") + n <= F.size("words"), key("words", F.col("i"), n)) for n in lengths])).alias("h"))
    found = rows.join(F.broadcast(whole), "h").where(F.slice("words", F.col("i") + 1, F.size("item")) == F.col("item"))
    n = F.size("item")
    return found.select("doc_id", "item_id", n.alias("item_words"), F.col("i").alias("start_word"), n.alias("n_words"), n.alias("n_same"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, start_word, n_words, n_same of its longest
    segment, ``share`` of the segment's words that agree and ``covered`` share of the item. Documents without a leak have no row."""
    given = benchmark.select(F.col(item_col).alias("item_id"), _words(F.col(item_text_col)).alias("item")).where(F.size("item") > 0)
    n = F.size("item")
    # seeds and words of the broadcast sides, and which lengths (below SPAN, so a few at most) short items have
    total, lengths = given.agg(F.coalesce(F.sum(F.greatest(n, n * F.lit(len(MASKS)) * (n >= SPAN).cast("int"))), F.lit(0)), F.array_sort(F.collect_set(F.when(n < SPAN, n)))).first()
    blocks = -(-total // BLOCK_SEEDS)
    rows = docs.select(F.col(id_col).alias("doc_id"), _words(F.col(text_col)).alias("words"))

    def probe(items: DataFrame) -> DataFrame:
        found = _probe(rows, items.where(n >= SPAN))
        return found.unionAll(_short(rows, items.where(n < SPAN), lengths)) if lengths else found

    if blocks <= 1:
        found = probe(given)
    else:
        items = write_table(given.withColumn("block", F.pmod(F.xxhash64("item_id", "item"), F.lit(int(2 * blocks)))), "items")
        found = reduce(DataFrame.unionAll, [probe(items.where(F.col("block") == b).drop("block")) for b in range(2 * blocks)])
    best = F.max(F.struct("n_same", "n_words", (-F.col("start_word")).alias("neg_start"), "item_words")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("b.neg_start")).cast("long").alias("start_word"), F.col("b.n_words").cast("long").alias("n_words"), F.col("b.n_same").cast("long").alias("n_same"),
        (F.col("b.n_same") / F.col("b.n_words")).alias("share"), (F.col("b.n_same") / F.col("b.item_words")).alias("covered"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a leak of ``LEAST`` words or more: items of fewer are phrases that clean texts
    hold too. Rows with a null id go if any row with a null id holds a leak."""
    bad = write_table(leaks(docs, benchmark, id_col, text_col).where(F.col("n_words") >= LEAST).select("doc_id").distinct(), "leaked")
    # the rows' own columns stay within a struct: none of their names can meet those of the join
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    kept = rows.join(bad.withColumnRenamed("doc_id", "_leaked"), F.col(f"_row.`{id_col}`").eqNullSafe(F.col("_leaked")), "left_anti")
    return kept.select("_row.*")
