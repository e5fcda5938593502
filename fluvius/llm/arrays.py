"""Running states over arrays, and pieces of long texts, in time near linear in their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_RUN = 128  # elements appended one by one before they are put aside as one
_CHUNK = 1024  # code points of a chunk


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], out_type: str) -> Column:
    """``out(state before, x)`` of every element x, the state going on by ``step(state, x)``. An appended array is copied, so that
    appending n elements to one costs n * n; elements are put in runs, and runs in the result."""

    def one(a: Column, x: Column) -> Column:
        return F.struct(step(a["state"], x).alias("state"), F.concat(a["out"], F.array(out(a["state"], x))).alias("out"))

    def run(a: Column, block: Column) -> Column:
        begin = F.struct(a["last"]["state"].alias("state"), F.array().cast(out_type).alias("out"))
        return F.struct(F.aggregate(block, begin, one).alias("last"), F.concat(a["outs"], F.array(a["last"]["out"])).alias("outs"))

    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / _RUN).cast("int") - 1, F.lit(0))), lambda b: F.slice(items, b * _RUN + 1, _RUN))
    begin = F.struct(F.struct(zero.alias("state"), F.array().cast(out_type).alias("out")).alias("last"), F.array().cast(f"array<{out_type}>").alias("outs"))
    return F.aggregate(blocks, begin, run, lambda a: F.flatten(F.concat(a["outs"], F.array(a["last"]["out"]))))


def chunks(text: Column) -> Column:
    """The text in chunks, from which ``piece`` cuts without going through the text from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))


def piece(cut: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of the text that ``cut`` has the chunks of."""
    a, b = F.floor(start / _CHUNK).cast("int"), F.floor(end / _CHUNK).cast("int")
    first = F.coalesce(F.get(cut, a), F.lit(""))
    within = F.substring(first, start % _CHUNK + 1, end - start)
    across = F.concat(F.substring(first, start % _CHUNK + 1, F.lit(_CHUNK)), F.array_join(F.slice(cut, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substring(F.coalesce(F.get(cut, b), F.lit("")), F.lit(1), end % _CHUNK))
    return F.when(a == b, within).otherwise(across)
