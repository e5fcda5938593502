"""Markdown documents as rows: tables of runs, and blocks kept up to date between markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvius.operators.history import latest


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, halves to even, thousands apart."""
    return F.format_number(F.bround(x, digits), digits)


def share(x: Column, digits: int = 0) -> Column:
    """A fraction as a percentage."""
    return F.concat(fixed(x * 100, digits), F.lit("%"))


def row(*cells: Column) -> Column:
    """A table row; NULL cells are empty, and bars and line breaks in cells do not end them."""
    safe = [F.coalesce(F.regexp_replace(F.regexp_replace(c.cast("string"), r"\|", r"\\|"), r"[\r\n]+", " "), F.lit("")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *safe), F.lit(" |"))


def run_table(sites: DataFrame, runs: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """(slug, line) of each site (slug, name, home): its newest run's metrics, or that it failed (column ``failed``) or never ran.
    ``ord`` sorts sites from abroad first, then by slug."""
    last = latest(runs, 1).withColumn("_ran", F.lit(True)).drop("name", "home")
    d = sites.select("slug", "name", "home").join(last, "slug", "left")
    state = F.when(F.col("_ran").isNull(), F.lit("_not run_")).when(F.coalesce("failed", F.lit(False)), F.lit("**FAILED**"))
    first, *rest = metrics.values()
    cells = [F.coalesce(state, first.cast("string")), *[F.when(state.isNull(), m) for m in rest]]
    w = F.struct(F.col("home").alias("home"), F.col("slug").alias("slug"))
    return d.select("slug", w.alias("ord"), row(F.col("name"), *cells).alias("line"))


def joined(lines: DataFrame, header: str) -> DataFrame:
    """One row, ``text``: a header and the lines (ord, line) in order. Documents hold a line a site, not a line a pixel."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n")
    return lines.agg(F.concat(F.lit(header + "\n"), body).alias("text"))


def put_block(text: Column, block: Column, start: str, end: str, heading: str) -> Column:
    """``text`` with what stands between two markers replaced by ``block``; without markers what follows the heading, and without
    that a heading and the block are added at the end. A NULL text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    whole = F.concat(F.lit(start + "\n"), block, F.lit("\n" + end))
    head = F.substring_index(text, start, 1)
    tail = F.substring(text, F.length(head) + 1 + len(start), F.length(text))
    after = F.substring(tail, F.length(F.substring_index(tail, end, 1)) + 1 + len(end), F.length(text))
    marked = F.contains(text, F.lit(start)) & F.contains(text, F.lit(end))
    under = F.concat(F.substring_index(text, heading, 1), F.lit(heading + "\n\n"), whole, F.lit("\n"))
    added = F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("\n\n" + heading + "\n\n"), whole, F.lit("\n"))
    return F.when(marked, F.concat(head, whole, after)).when(F.contains(text, F.lit(heading)), under).otherwise(added)
