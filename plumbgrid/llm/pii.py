"""Personal data: patterns propose spans, checksums confirm them, words nearby (on both sides) adjust a score.

An account number (iban) has its country's length, blanks between its characters not counted, and passes mod 97, and
does not begin inside one that does; a
social security number (ssn) has no area of 000, 666 or 9xx, no group 00 and no serial 0000, and needs a word of its
kind within `CONTEXT` characters before or behind it.

DataFrame functions only. The patterns are written without loops over groups, which Java's matcher runs by
recursion, so that very long runs can't overflow its stack; each note says why the rewritten pattern finds the
same spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, load, text_or_empty
from .spans import after, before, digest, gaps, located, matches

#: Stands for a dot that no label follows; the private character itself is replaced in texts first.
_DOT, _OTHER = "\uE000", "\uE001"
_LOCAL = rf"[A-Za-z0-9._%+{_DOT}-]"
#: A run of local characters can only match from its start, or from the end of the match before it.
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: After separators that don't stand between two digits became _OTHER, a run of digits and separators is a whole match.
CARD = r"(?<![0-9\x20-])[0-9\x20-]{14,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The length of account numbers by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_BY_LENGTH = "|".join(f"(?:{'|'.join(countries.split())})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, countries in IBAN_LENGTHS.items())
#: A match is the first four characters and group 1 the whole span, so that a number may begin inside one that fails
#: its check. The first look ahead turns most places down before the countries are tried one by one.
IBAN = rf"(?<![A-Za-z0-9])(?=[A-Z][A-Z][0-9][0-9])(?=({_BY_LENGTH})(?![A-Za-z0-9]))[A-Z][A-Z][0-9][0-9]"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"

#: Kinds in their order, with the score of a confirmed span and the words that raise it.
KINDS = [
    ("email", 0.90, r"(?i)mail|contact|write|kontakt|correo|courriel"),
    ("ip", 0.60, r"(?i)\bip\b|address|host|server|adresse"),
    ("card", 0.80, r"(?i)card|visa|master|credit|karte|carte|tarjeta|payment"),
    ("phone", 0.70, r"(?i)phone|call|tel|mobile|fax|telefon"),
    ("iban", 0.90, r"(?i)iban|account|bank|konto|compte|cuenta"),
    ("ssn", 0.30, r"(?i)\b(?:ssn|social|security|tax)\b"),
]
CONTEXT = 48
RAISE = 0.1
#: The kinds whose pattern has no checksum need a word nearby.
NEEDS_CONTEXT = {"ssn"}
_SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double,hit:string>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    backwards = F.reverse(digits)

    def at(i: Column) -> Column:
        d = backwards.substr(i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), at), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number (upper-case letters and digits) leaves 1 modulo 97 with its first four moved to the end."""
    moved = F.concat(code.substr(F.lit(5), F.length(code)), code.substr(F.lit(1), F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v >= 65, (acc * 100 + v - 55) % 97).otherwise((acc * 10 + v - 48) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


def _confirmed(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.regexp_replace(p, "^0+(?=.)", "").substr(F.lit(1), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        code = F.replace(hit, F.lit(" "), F.lit(""))
        return mod97(code)
    return F.lit(True)


def _widened(s: Column, whole: Column) -> Column:
    """The span that begins where s begins and holds `whole`."""
    return F.struct(s["start"].alias("start"), (s["start"] + F.length(whole)).alias("end"), whole.alias("hit"), s["at"].alias("at"))


def _apart(spans: Column) -> Column:
    """Spans in order of their starts without those that begin inside one kept before them."""

    def step(acc: Column, s: Column) -> Column:
        return F.when(F.coalesce(s["start"] >= F.try_element_at(acc, F.lit(-1))["end"], F.lit(True)), F.concat(acc, F.array(s))).otherwise(acc)

    return F.aggregate(spans, F.array().cast("array<struct<start:bigint,end:bigint,hit:string,at:int>>"), step)


def _kept(rank: int, kind: str, score: float, words: str) -> Column:
    """The confirmed spans of one kind, scored by the words around them."""

    def span(s: Column) -> Column:
        near = before(F.col("__text"), s["start"], CONTEXT).rlike(words) | after(F.col("__text"), s["end"], CONTEXT).rlike(words)
        scored = F.when(near, F.lit(score + (0.4 if kind in NEEDS_CONTEXT else RAISE))).otherwise(F.lit(score))
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), scored.alias("score"), s["hit"].alias("hit"))

    spots = located(F.col(f"__m_{kind}"), F.col(f"__g_{kind}"))
    if kind == "iban":
        spots = F.transform(spots, lambda s: _widened(s, F.get(F.col("__whole_iban"), s["at"])))
    confirmed = F.filter(spots, lambda s: _confirmed(kind, s["hit"]))
    spans = F.transform(_apart(confirmed) if kind == "iban" else confirmed, span)
    if kind in NEEDS_CONTEXT:
        spans = F.filter(spans, lambda s: s["score"] >= 0.5)
    return F.when(F.size(F.col(f"__m_{kind}")) > 0, spans).otherwise(F.array().cast(_SPANS))


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: its id, __text, and `spans`, array<struct<start, rank, end, kind, score, hit>>.

    Starts and ends count code points, ends are exclusive; spans stand in no stated order. Null texts count as
    empty; repeated rows are kept; other columns of `docs` are ignored, whatever their names.
    """
    t = F.col("__text")
    rows = docs.select(column(id_col).alias("__id"), text_or_empty(text_col).alias("__text"))
    has_at, long_number = t.contains("@"), t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")
    rows = rows.select(
        "*",
        F.when(has_at, F.regexp_replace(F.translate(t, _DOT, _OTHER), r"\.(?![A-Za-z0-9-])", _DOT)).otherwise(F.lit("")).alias("__for_email"),
        F.when(long_number, F.regexp_replace(t, r"[\x20-](?![0-9])|(?<![0-9])[\x20-]", _OTHER)).otherwise(F.lit("")).alias("__for_card"),
    )
    plan = {
        "email": (F.col("__for_email"), EMAIL, None),
        "ip": (t, IP, None),
        "card": (F.col("__for_card"), CARD, None),
        "phone": (t, PHONE, t.contains("+")),
        "iban": (t, IBAN, t.rlike("[A-Z][A-Z][0-9][0-9]")),
        "ssn": (t, SSN, None),
    }
    rows = rows.select("*", *[matches(s, p, when).alias(f"__m_{k}") for k, (s, p, when) in plan.items()])
    rows = rows.select("*", *[gaps(s, p, F.col(f"__m_{k}")).alias(f"__g_{k}") for k, (s, p, _) in plan.items()])
    rows = rows.withColumn("__whole_iban", matches(t, IBAN, F.size("__m_iban") > 0, 1))
    found = [_kept(rank, kind, score, words) for rank, (kind, score, words) in enumerate(KINDS)]
    return rows.select("__id", "__text", F.concat(*found).alias("spans"))


def pii_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of pii_spans: the id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more, max_score (0 without spans)."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["rank"] < 4)
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return pii_spans(docs, id_col, text_col).select(
        F.col("__id").alias(id_col),
        *[count(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(digest(base), 256).alias("base_sha256"),
        digest(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: s["rank"] >= 4)).cast("long").alias("n_more"),
        F.coalesce(F.array_max(F.transform(spans, lambda s: s["score"])), F.lit(0.0)).alias("max_score"),
    )


def op2_pii(spark, sf_dir):
    return pii_scan(load(spark, sf_dir, "documents"))
