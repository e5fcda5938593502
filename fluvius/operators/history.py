"""Run histories: latest runs, caps, drift, checks against ranges, names and hashes."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(runs: DataFrame, keep: int = 1) -> DataFrame:
    """The last ``keep`` runs of each slug in order of ``seq``, the newest with back = 1."""
    w = Window.partitionBy("slug").orderBy(F.col("seq").desc())
    return runs.withColumn("back", F.row_number().over(w)).where(F.col("back") <= keep)


def drift(runs: DataFrame) -> DataFrame:
    """The newest run of each slug against the one before: what changed beyond the limits (buildable by more than 2 points, scale or
    source count at all, seam more than twofold and above 0.2, where terrain or water come from). Of runs that failed (column
    ``failed``, if any) only that counts."""
    last = latest(runs, 2)
    new, old = last.where("back = 1").alias("n"), last.where("back = 2").alias("o")
    n, o = (lambda c: F.col(f"n.{c}")), (lambda c: F.col(f"o.{c}"))
    what = F.array_compact(F.array(
        F.when(F.abs(n("buildable") - o("buildable")) > 0.02, "buildable"), F.when(n("scale") != o("scale"), "scale"),
        F.when(n("sources") != o("sources"), "sources"), F.when((n("seam") > 2 * o("seam")) & (n("seam") > 0.2), "seam")))
    for c in ("dem_source", "hydro_source"):
        if c in runs.columns:
            what = F.array_compact(F.concat(what, F.array(F.when(~n(c).eqNullSafe(o(c)), c))))
    if "failed" in runs.columns:
        a, b = F.coalesce(n("failed"), F.lit(False)), F.coalesce(o("failed"), F.lit(False))
        what = F.when(a | b, F.array_compact(F.array(F.when(a & ~b, "failed").when(b & ~a, "now builds")))).otherwise(what)
    return new.join(old, F.col("n.slug") == F.col("o.slug")).select(n("slug").alias("slug"), what.alias("drift"))


def check(runs: DataFrame, ranges: DataFrame, metrics: list[str]) -> DataFrame:
    """Metrics of each slug's newest run outside the inclusive range (lo, hi) expected; NULL bounds are open, NULL values pass."""
    last = latest(runs, 1)
    long = last.select("slug", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select("slug", "m.*")
    bad = (F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))
    return ranges.join(long, ["slug", "metric"]).where(F.coalesce(F.col("value") < F.col("lo"), F.lit(False)) | F.coalesce(F.col("value") > F.col("hi"), F.lit(False)) | F.coalesce(bad, F.lit(False))).select("slug", "metric", "value")


def seeded(runs: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """``expected`` for the sites without ranges yet (``known``: slug), or all with ``force``; not of runs that failed."""
    last = latest(runs, 1).drop("back")
    last = last.where(~F.coalesce("failed", F.lit(False))) if "failed" in runs.columns else last
    return expected(last if force else last.join(known.select("slug"), "slug", "left_anti"))


def expected(runs: DataFrame) -> DataFrame:
    """Ranges around each slug's newest run."""
    b, s, w, k, m = (F.col(c) for c in ("buildable", "scale", "water", "sources", "seam"))
    return latest(runs, 1).select("slug", (b - 0.05).alias("buildable_lo"), (b + 0.05).alias("buildable_hi"), (s * 0.9).alias("scale_lo"), (s * 1.1).alias("scale_hi"), (w - 0.02).alias("water_lo"), (w + 0.02).alias("water_hi"), (k - 3).alias("sources_lo"), (k + 3).alias("sources_hi"), F.greatest(F.lit(0.5), m * 2).alias("seam_hi"))


def display_name(slug: Column) -> Column:
    """A title from a slug: without its prefix, separators as spaces, words capitalised."""
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(slug, "^bench_", ""), "[_\\- ]+", " ")))


def request_hash(*fields: tuple[str, Column]) -> Column:
    """The first 16 hex digits of the sha1 of compact JSON with sorted keys, nulls kept."""
    s = F.struct(*[c.alias(k) for k, c in sorted(fields, key=lambda f: f[0])])
    return F.substring(F.sha1(F.to_json(s, {"ignoreNullFields": "false"})), 1, 16)


def key_for(params: dict) -> str:
    """The same hash of a dictionary on the driver."""
    return hashlib.sha1(json.dumps(params, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
