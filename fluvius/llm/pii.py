"""Personal data: regular expressions propose spans, checksum validators confirm them, nearby context words adjust the score.

One narrow pass of DataFrame expressions. Every pattern is tried only on texts that hold its anchor (``@``, ``+``, a digit
pattern), and each is written so that a scan is linear in the text: starts inside a run that was already tried are skipped.

Spans are code-point offsets, end exclusive. The base kinds (email, ip, card, phone) are taken leftmost and non-overlapping
per kind; a match whose validator fails is dropped and not retried. The method adds kinds: ``iban`` (mod 97) and ``ssn``
(issued ranges, and a context word). Context is the 40 code points before a match, and those after it up to 40 or the next
match of its kind.

Edge cases: null or empty texts have no spans; repeated rows give repeated results; a null id is returned as it is; other
columns are ignored. Texts that hold the control characters U+0001 and U+0002 are handled: these count as any other
character that is in no pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvius.llm.arrays import chunks, piece, running

#: Order of kinds among spans that start at the same place.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
CONTEXT = 40  # code points looked at on either side

_LOCAL = "[A-Za-z0-9._%+-]"
_PATTERNS = {
    # \\G: a match may start where the last one ended, even inside a run of these characters
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
_GATES = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]++\.[0-9]")),
    "card": lambda t: F.rlike(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}")),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "iban": lambda t: F.rlike(t, F.lit(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}")),
    "ssn": lambda t: F.rlike(t, F.lit(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")),
}
_WORDS = {
    "email": r"e-?mail|contact|write|mailto|adresse|correo|courriel",
    "ip": r"\bip\b|address|host|server|adresse|login|serveur",
    "card": r"card|visa|master|amex|payment|credit|karte|carte|tarjeta|pay",
    "phone": r"phone|call|tel|mobile|fax|contact|anruf|appel|llam",
    "iban": r"iban|account|bank|transfer|konto|compte|cuenta|virement",
    "ssn": r"ssn|social security|sozialversicherung|s[ée]curit[ée] sociale|seguro social",
}
#: kind -> score of a valid span without and with context.
_SCORES = {"email": (0.9, 1.0), "ip": (0.7, 0.9), "card": (0.7, 0.95), "phone": (0.7, 0.95), "iban": (0.9, 1.0), "ssn": (0.3, 0.9)}
LEAST = 0.5  # spans that the method adds need this score

_FOUND = "array<struct<start:int,end:int,found:string,near:string>>"
_SPAN = "array<struct<start:int,k:int,end:int,kind:string,score:double>>"


def _found(text: Column, kind: str) -> Column:
    """All matches with their offsets and surroundings, in text order."""
    parts = F.split(F.regexp_replace(text, _PATTERNS[kind], "\u0001$0\u0002"), "\u0001")
    zero = F.struct(F.length(parts[0]).alias("at"), F.right(parts[0], F.lit(CONTEXT)).alias("left"))

    def step(a: Column, part: Column) -> Column:
        return F.struct((a["at"] + F.length(part) - 1).alias("at"), F.right(F.concat(a["left"], F.replace(part, F.lit("\u0002"), F.lit(""))), F.lit(CONTEXT)).alias("left"))

    def one(a: Column, part: Column) -> Column:
        found = F.substring_index(part, "\u0002", 1)
        near = F.concat(a["left"], F.lit(" "), F.left(F.substring_index(part, "\u0002", -1), F.lit(CONTEXT)))
        return F.struct(a["at"].alias("start"), (a["at"] + F.length(found)).alias("end"), found.alias("found"), near.alias("near"))

    return running(F.slice(parts, 2, F.size(parts)), zero, step, one, _FOUND)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def weigh(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).when(n > 4, 2 * n - 9).otherwise(2 * n)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weigh), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN's check digits hold (ISO 7064 mod 97)."""
    compact = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(compact, 5, 64), F.left(compact, F.lit(4)))

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (a * 100 + code - 55) % 97).otherwise((a * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _valid(kind: str, s: Column) -> Column:
    n = F.length(_digits(s))
    part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: F.rlike(s, F.lit(rf"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])\.){{3}}0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])$")),
        "card": lambda: n.between(12, 19) & luhn(_digits(s)),
        "phone": lambda: n.between(9, 15),
        "iban": lambda: F.length(F.replace(s, F.lit(" "), F.lit(""))).between(15, 34) & mod97(s),
        "ssn": lambda: ~F.rlike(s, F.lit(r"^(?:000|666|9)|-00-|-0000$")),
    }[kind]()


def _spans(text: Column, kind: str) -> Column:
    k = KINDS.index(kind)
    plain, backed = _SCORES[kind]

    def span(m: Column) -> Column:
        score = F.when(F.rlike(F.lower(m["near"]), F.lit(_WORDS[kind])), F.lit(backed)).otherwise(F.lit(plain))
        return F.struct(m["start"].alias("start"), F.lit(k).alias("k"), m["end"].alias("end"), F.lit(kind).alias("kind"), score.alias("score"))

    out = F.transform(F.filter(_found(text, kind), lambda m: _valid(kind, m["found"])), span)
    if kind not in BASE_KINDS:
        out = F.filter(out, lambda x: x["score"] >= LEAST)
    return F.coalesce(F.when(_GATES[kind](text), out), F.array().cast(_SPAN))


def _scanned(df: DataFrame) -> DataFrame:
    """``df``, whose text is in ``_text``, with ``spans``."""
    given = F.coalesce(F.col("_text"), F.lit(""))
    clean = F.when(F.rlike(given, F.lit("[\u0001\u0002]")), F.translate(given, "\u0001\u0002", "\u0003\u0003")).otherwise(given)
    each = F.concat(*[_spans(F.col("_clean"), k) for k in KINDS])
    any_gate = F.rlike(F.col("_clean"), F.lit("[@+]|[0-9]"))
    return df.withColumn("_clean", clean).withColumn("spans", F.coalesce(F.when(any_gate, F.array_sort(each)), F.array().cast(_SPAN))).drop("_clean")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``spans`` array<struct<start, k, end, kind, score>> by start, then kind."""
    return _scanned(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))).drop("_text")


def _names(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns of ``scan``'s rows."""
    base = F.filter("spans", lambda x: x["k"] < len(BASE_KINDS))

    def count(i: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["k"] == i)).cast("long")

    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(BASE_KINDS)]
    best = F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0))
    return scanned.select("doc_id", *counts, F.sha2(_names(base), 256).alias("base_sha256"), _names(F.col("spans")).alias("spans"), best.alias("score"))


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span's text replaced by its kind in brackets; overlapping spans are replaced as one, under the first's kind."""
    cols = docs.columns
    df = _scanned(docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), F.col(f"`{text_col}`").alias("_text")))
    text, spans = F.col("_text"), F.col("spans")

    def reach(a: Column, x: Column) -> Column:
        return F.greatest(a, x["end"])

    def one(a: Column, x: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), a.alias("before"))

    # a span that begins behind all before it begins a masked stretch, which ends where all before the next such span do
    first = F.filter(running(spans, F.lit(0), reach, one, "array<struct<start:int,kind:string,before:int>>"), lambda x: x["start"] >= x["before"])
    df = df.withColumn("_first", F.when(F.size("spans") > 0, first)).withColumn("_cut", F.when(F.size("spans") > 0, chunks(text)))
    before = F.transform("_first", lambda x: F.concat(piece(F.col("_cut"), x["before"], x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    tail = piece(F.col("_cut"), F.array_max(F.transform(spans, lambda x: x["end"])), F.length(text))
    masked = F.when(F.size("spans") == 0, text).otherwise(F.concat(F.array_join(before, ""), tail))
    return df.select(*[masked.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in cols])
