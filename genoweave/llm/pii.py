"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Everything is DataFrame functions; no Python runs on the executors. A pattern's
matches come from ``regexp_extract_all`` and their places from the pieces that
``split`` leaves between them, so both passes are linear in the text. The
patterns are written so that a failing start can't be tried again inside the
same run of characters (lookbehind and possessive quantifiers); they find the
same leftmost, non-overlapping matches as the plain forms.

A detected span has kind, start, end (code points, end exclusive) and a score:
the kind's prior, raised where one of the kind's context words stands within
``CONTEXT_CHARS`` characters before or after it, whatever lies between, or before
the first of a list of matches it stands in. Kinds marked ``always`` are kept at any
score, others from ``threshold`` on. Null and empty texts have no spans.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import free_name, table

CONTEXT_CHARS = 40
LIST_GAP = r"^[^A-Za-z0-9]{1,5}(?:(?i:and|or|und|y|et)[^A-Za-z0-9]{1,5})?$"  # what stands between the matches of a list
BLOCK = 256  # matches folded at a time, so that appending stays near linear

Span = "array<struct<kind:string,start:int,end:int,score:double>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_valid(text: Column) -> Column:
    """The digits of ``text`` pass the Luhn checksum."""
    backwards = F.split(F.reverse(_digits(text)), "")
    summed = F.aggregate(
        F.transform(backwards, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))),
        F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)),
    )
    return summed % 10 == 0


def mod97_valid(text: Column) -> Column:
    """``text`` (letters and digits, spaces ignored) passes the IBAN mod-97 check."""
    plain = F.upper(F.regexp_replace(text, " ", ""))
    turned = F.concat(F.substring(plain, 5, 1000), F.substring(plain, 1, 4))
    letters = F.filter(F.split(turned, ""), lambda c: F.length(c) > 0)
    rest = F.aggregate(
        F.transform(letters, lambda c: F.ascii(c) - F.when(c <= "9", 48).otherwise(55)),
        F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97,
    )
    return rest == 1


def _card(text: Column) -> Column:
    n = F.length(_digits(text))
    return n.between(14, 19) & luhn_valid(text)


def _ip(text: Column) -> Column:
    return F.forall(F.split(text, "\\."), lambda part: part.cast("double") <= 255)


def _phone(text: Column) -> Column:
    return F.length(_digits(text)).between(10, 15)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: Callable[[Column], Column] | None = None
    hint: str | None = None  # a string every match contains, for a cheap first look
    prior: float = 0.9
    always: bool = True
    context: tuple[str, ...] = field(default=())
    bonus: float = 0.1
    shortest: int = 2  # characters of the shortest match


#: The base kinds, in the order that breaks ties.
BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         hint="@", context=("mail", "contact", "correo", "courriel"), shortest=5),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", _ip, hint=".", prior=0.7,
         context=("ip", "host", "server", "address"), bonus=0.3, shortest=7),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _card, prior=0.8,
         context=("card", "visa", "credit", "tarjeta", "carte", "karte"), bonus=0.2),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, hint="+", prior=0.8,
         context=("phone", "tel", "call", "mobile", "fax"), bonus=0.2, shortest=4),
)
#: Kinds the method adds: one needs the mod-97 checksum, one needs context.
ADDED = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
         mod97_valid, prior=0.9, always=False, context=("iban", "account", "konto", "compte", "cuenta"), shortest=12),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", None, hint="-", prior=0.3, always=False,
         context=("ssn", "social security", "national id"), bonus=0.6, shortest=11),
)


def _possible(text: Column, kind: Kind) -> Column:
    seen = text.isNotNull() & text.rlike(kind.pattern)
    return text.contains(kind.hint) & seen if kind.hint else seen


def _pairs(text: Column, kind: Kind) -> Column:
    """Each match with the gap before it (the last entry is the gap after all matches)."""
    gaps, hits = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    return F.when(_possible(text, kind), F.arrays_zip(gaps.alias("gap"), hits.alias("hit")))


def _spans(pairs: Column, kind: Kind, threshold: float) -> Column:
    """Confirmed spans, in order, from the pairs of a kind (null: none)."""
    raw = "array<struct<start:int,hit:string,near:string,place:int>>"
    hit = lambda x: F.coalesce(x["hit"], F.lit(""))
    last = lambda *parts: F.right(F.concat(*parts), F.lit(CONTEXT_CHARS))
    carried = ("at", "place", "tail", "near")  # end, place and text before of the last match, and its context

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        before = last(acc["tail"], last(x["gap"]))
        near = F.when((acc["place"] > 0) & (F.length(x["gap"]) <= CONTEXT_CHARS) & x["gap"].rlike(LIST_GAP), F.concat(acc["near"], F.lit(" "), before)).otherwise(before)
        return F.struct(
            (start + F.length(hit(x))).alias("at"), (acc["place"] + 1).alias("place"), last(before, last(hit(x))).alias("tail"),
            F.left(near, F.lit(CONTEXT_CHARS)).alias("near"),
            F.concat(acc["out"], F.array(F.struct(start.alias("start"), hit(x).alias("hit"), near.alias("near"), acc["place"].alias("place")))).alias("out"),
        )

    def block(acc: Column, b: Column) -> Column:
        inner = F.aggregate(
            F.slice(pairs, b * BLOCK + 1, BLOCK), F.struct(*(acc[c].alias(c) for c in carried), F.array().cast(raw).alias("out")), step)
        return F.struct(*(inner[c].alias(c) for c in carried), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    def after(x: Column) -> Column:
        """The characters after a match, from the gaps and matches that can lie in them."""
        cut = lambda s: F.left(s, F.lit(CONTEXT_CHARS))
        following = F.slice(pairs, x["place"] + 2, -(-CONTEXT_CHARS // kind.shortest))
        return cut(F.array_join(F.transform(following, lambda p: F.concat(cut(p["gap"]), cut(hit(p)))), ""))

    blocks = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int"))
    folded = F.aggregate(
        blocks, F.struct(F.lit(0).alias("at"), F.lit(0).alias("place"), F.lit("").alias("tail"), F.lit("").alias("near"), F.array().cast(f"array<{raw}>").alias("out")), block,
        lambda acc: F.flatten(acc["out"]),
    )
    hits = F.filter(folded, lambda x: (F.length(x["hit"]) > 0) & (kind.valid(x["hit"]) if kind.valid else F.lit(True)))
    words = r"(?i)(?<![A-Za-z])(?:" + "|".join(kind.context) + r")"
    score = lambda x: F.lit(kind.prior) + F.when(x["near"].rlike(words) | after(x).rlike(words), F.lit(kind.bonus)).otherwise(F.lit(0.0))
    spans = F.transform(hits, lambda x: F.struct(
        F.lit(kind.name).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["hit"])).alias("end"),
        score(x).alias("score"),
    ))
    if not kind.always:
        spans = F.filter(spans, lambda s: s["score"] >= threshold)
    return F.when(pairs.isNotNull(), spans).otherwise(F.array().cast(Span))


def _ordered(*arrays: Column) -> Column:
    """All spans by start, then kind in the order of the arguments, then end."""
    ranked = [F.transform(a, lambda s, k=k: F.struct(
        s["start"].alias("start"), F.lit(k).alias("order"), s["end"].alias("end"), s["kind"].alias("kind"), s["score"].alias("score"),
    )) for k, a in enumerate(arrays)]
    return F.array_sort(F.concat(*ranked))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(df: DataFrame, text: str = "text", prefix: str = "pii_", threshold: float = 0.5) -> DataFrame:
    """Add ``<prefix><kind>`` arrays for every kind, and ``<prefix>base`` and ``<prefix>spans`` with all in order.

    Columns with these names are replaced, all others pass through.
    """
    names = [k.name for k in BASE + ADDED]
    out = df
    for kind in BASE + ADDED:
        pairs = free_name(out.columns, "pairs_of_" + kind.name)
        # a column of its own: the fold below refers to it more than once
        out = out.withColumn(pairs, _pairs(F.col(text), kind))
        out = out.withColumn(prefix + kind.name, _spans(F.col(pairs), kind, threshold)).drop(pairs)
    return out.withColumn(prefix + "base", _ordered(*(F.col(prefix + k.name) for k in BASE))).withColumn(
        prefix + "spans", _ordered(*(F.col(prefix + n) for n in names)))


def redact(df: DataFrame, text: str = "text", prefix: str = "pii_") -> DataFrame:
    """Replace every detected span by ``<KIND>``; of overlapping spans the first gives the name and all are covered."""
    t, spans = F.col(text), F.col(prefix + "spans")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], F.array(
                F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")),
            ))).otherwise(acc["out"]).alias("out"),
        )

    done = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(t, acc["at"] + 1, F.length(t))))
    return df.withColumn(text, F.when(F.size(spans) > 0, done).otherwise(t))


def op10_pattern_checksum_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every document.

    One row per row, repeated ones too. Null and empty texts have no spans; of
    spans with one start the kinds' order decides.
    """
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(F.size(f"pii_{k.name}").cast("long").alias(f"n_{k.name}") for k in BASE),
        F.sha2(_written(F.col("pii_base")), 256).alias("base_sha256"),
        _written(F.col("pii_spans")).alias("spans"),
    )
