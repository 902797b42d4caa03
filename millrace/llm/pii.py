"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checksums confirm them, and words nearby move
the score. Offsets are code points, ends exclusive. The matches of a pattern are
placed by splitting the text at the same pattern: the pieces between matches and
the matches give all positions by running sums.

Base kinds (email, ip, card, phone) are kept whenever their own check passes,
whatever the score. Added kinds need a score of ``least`` or more, so the words around
decide: a number in the form of an ssn, or a long token of letters and digits, counts only
near a word that names it (ssn, password, token), an iban and a key id also without one, but
an iban not near a word that speaks against it (order, invoice) unless another speaks for it.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked

# Possessive quantifiers where backtracking can't lead to another match, so that
# long runs without a match are not scanned again and again.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "keyid": r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+",
}
BASE = ("email", "ip", "card", "phone")
#: A text without it has no match; null where no single character is needed.
NEEDS = {"email": "@", "phone": "+", "ip": ".", "ssn": "-", "keyid": "IA"}
#: Score of a confirmed span, and what a context word nearby adds or takes.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7, "ssn": 0.4, "keyid": 0.8, "secret": 0.3}
WITH = {
    "email": r"(?i)\b(?:mail|contact|write|schreib|correo|courriel)",
    "ip": r"(?i)\b(?:ip|host|server|login|address)",
    "card": r"(?i)\b(?:card|visa|credit|karte|carte|tarjeta|payment)",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|appel)",
    "iban": r"(?i)\b(?:iban|bank|account|konto|compte|cuenta)",
    "ssn": r"(?i)\b(?:ssn|social|security|tax)",
    "keyid": r"(?i)\b(?:key|aws|access|credential)",
    "secret": r"(?i)(?:\b|_)(?:token|secret|passw|pwd|api.?key|credential)",
}
AGAINST = r"(?i)\b(?:order|invoice|version|serial|isbn|sku|build)\b"
REACH = 40


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Luhn's check of a string of digits."""
    each = F.transform(
        F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int"))
    )
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """The check of an account number: moved, letters as 10 to 35, remainder 1."""
    plain = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    step = lambda a, ch: F.when(ch.between("0", "9"), a * 10 + F.ascii(ch) - 48).otherwise(a * 100 + F.ascii(ch) - 55) % 97
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, ch: step(a, ch).cast("int")) == 1


def confirmed(kind: str, found: Column) -> Column:
    n = F.length(digits(found))
    if kind == "ip":
        plain = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(plain, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits(found))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return F.when(F.length(F.regexp_replace(found, " ", "")).between(15, 34), mod97(found)).otherwise(False)
    return F.lit(True)


def _placed(kind: str, pieces: Column, found: Column) -> Column:
    """Spans of the matches: struct(found, start, end), from the texts between them."""
    place = lambda a, p, i: F.struct(
        F.when(
            i < F.size(found),
            F.array_append(a["spans"], F.struct(F.get(found, i).alias("found"), (a["at"] + F.length(p)).alias("start"), (a["at"] + F.length(p) + F.length(F.get(found, i))).alias("end"))),
        ).otherwise(a["spans"]).alias("spans"),
        (a["at"] + F.length(p) + F.coalesce(F.length(F.get(found, i)), F.lit(0))).alias("at"),
    )
    numbered = F.transform(pieces, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    start = F.struct(F.array().cast("array<struct<found:string,start:int,end:int>>").alias("spans"), F.lit(0).alias("at"))
    return F.aggregate(numbered, start, lambda a, x: place(a, x["p"], x["i"]), lambda a: a["spans"])


def _score(kind: str, text: Column, s: Column) -> Column:
    near = F.substring(text, F.greatest(s["start"] + 1 - REACH, F.lit(1)), F.least(s["start"], F.lit(REACH)) + (s["end"] - s["start"]) + REACH)
    up = F.when(near.rlike(WITH[kind]), 0.3).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.lit(SCORE[kind]) + up - F.when(near.rlike(AGAINST), 0.2).otherwise(0.0)), 2)


def _is_good(kind: str, s: Column) -> Column:
    return confirmed(kind, s["found"])


def _span(order: int, kind: str, s: Column) -> Column:
    score = _score(kind, F.col("_text"), s)
    return F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), score.alias("score"), F.lit(kind in BASE).alias("base"))


def find(docs: DataFrame, least: float = 0.6) -> DataFrame:
    """Spans of personal data with their scores. Adds ``_text`` and ``pii``: array of (start, end, kind, score, base) in order.

    Defined cases: a null text is an empty one, and neither has spans; all rows are
    kept, repeated ones too; other columns pass through unchanged, but for those named as what
    is added, or ``_m_``, ``_s_`` or ``_p_`` and a kind (``masked`` keeps these, too).
    """
    df = docs.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    kinds = list(PATTERNS)
    for k in kinds:
        needed = F.contains(F.col("_text"), F.lit(NEEDS[k])) if k in NEEDS else F.col("_text").rlike(WITH[k] if SCORE[k] < least and k not in BASE else "[0-9]")
        df = df.withColumn(f"_m_{k}", F.when(needed, F.regexp_extract_all("_text", F.lit(PATTERNS[k]), 0)))
    for k in kinds:
        m = F.col(f"_m_{k}")
        worth = F.exists(m, partial(confirmed, k))
        df = df.withColumn(f"_s_{k}", F.when(worth, F.split("_text", PATTERNS[k], -1)))
    for n, k in enumerate(kinds):  # a kind's number is its place in the order of spans
        m, p = F.col(f"_m_{k}"), F.col(f"_s_{k}")
        scored = F.transform(F.filter(_placed(k, p, m), partial(_is_good, k)), partial(_span, n, k))
        df = df.withColumn(f"_p_{k}", F.when(p.isNotNull(), scored))
    empty = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,score:double,base:boolean>>")
    spans = F.array_sort(F.concat(*[F.coalesce(F.col(f"_p_{k}"), empty) for k in kinds]))
    df = df.withColumn("pii", F.filter(spans, lambda s: s["base"] | (s["score"] >= least)))
    return df.drop(*[f"_{x}_{k}" for k in kinds for x in "msp"])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of the base kinds, base_sha256, spans, and their scores in the same order."""
    found = find(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = joined(F.filter("pii", lambda s: s["base"]))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"))


def masked(docs: DataFrame) -> DataFrame:
    """The same rows with every span of personal data replaced by its kind in angle brackets.

    Spans that overlap an earlier one are covered by its replacement as far as it
    reaches and dropped beyond. Texts without spans, null ones too, stay as they are.
    """
    found = find(packed(docs, "text"))
    step = lambda a, s: F.struct(
        F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(F.col("_text"), a["at"] + 1, s["start"] - a["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(a["out"]).alias("out"),
        F.greatest(a["at"], s["end"]).alias("at"),
    )
    text = F.aggregate("pii", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda a: F.concat(a["out"], F.substring(F.col("_text"), a["at"] + 1, F.length("_text"))))
    return unpacked(found, docs.columns, text=F.when(F.size("pii") > 0, text).otherwise(F.col("text")))
