"""Secrets: known shapes, and strings that a battery of randomness tests takes for random.

DataFrame functions only. A candidate is a run of 16 or more of ``[A-Za-z0-9+/_-]``, but not one of 16 to 19 letters
of one case, which these tests can't tell from a long word. Its encoding is inferred from
the characters it uses; that gives an alphabet of K symbols. Three tests hold it against "drawn evenly and
independently from the alphabet":

* chi-squared of its symbol counts, upper tail: by Wilson and Hilferty, and for strings shorter than the alphabet,
  where the expected counts are under 1, by the number of pairs of equal symbols, which is the same statistic and
  nearly Poisson (in simulations at a level of 1/60 between 0.011 and 0.019 of random strings are below it);
* runs above and below the alphabet's middle (Wald-Wolfowitz), two-sided;
* lag-1 serial correlation of the symbol numbers, two-sided.

The combined p-value is three times the least, 1 at most. Random strings have p-values spread over [0, 1],
others crowd at 0. Per encoding and class of length, Storey's estimate from the p-values above one half gives
how many candidates are random, and so the share of false discoveries among those accepted at each level; the
least level with a share of ``fdr`` or less is taken. Where fewer than ``FEW`` candidates of a class reach ``ALONE``,
the estimate says nothing (half of all lone keys have no p-value above one half): there the p-value alone decides,
at ``ALONE``, which keeps 0.97 of random strings however few they are, and the share of false discoveries is
not controlled. The table it is read from has encodings x lengths x 100 rows whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, cut_lineage, load, text_or_empty
from .spans import digest, gaps, located, matches

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Both runs are whole matches from their start, so a minimum length drops nothing else.
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
_RUN = r"[A-Za-z0-9+/_-]"
#: Runs of 16 to 19 letters of one case are left out: these tests can't tell them from long words.
RANDOM = rf"(?<!{_RUN})(?!(?:[a-z]{{16,19}}|[A-Z]{{16,19}})(?!{_RUN})){_RUN}{{16,}}+"

#: Encodings by the characters they use, in the order of inference, with their alphabets.
ENCODINGS = [
    ("decimal", "[0-9]+", "0123456789"),
    ("hex", "[0-9a-f]+|[0-9A-F]+", "0123456789abcdef"),
    ("letters", "[a-z]+|[A-Z]+", "abcdefghijklmnopqrstuvwxyz"),
    ("base36", "[0-9a-z]+|[0-9A-Z]+", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("mixed", "[A-Za-z]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "[A-Za-z0-9+/_-]+", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/"),
]
LENGTHS = [16, 20, 24, 32, 48, 64, 128]
LEVELS = [0.01, 0.02, 0.05, 0.1, 0.2, 0.3]
FDR = 0.05
#: Of a class with fewer than FEW candidates at a p-value of ALONE or more, those are accepted.
FEW, ALONE = 20, 0.03
_SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def _upper_tail(z: Column) -> Column:
    """1 - the normal distribution function, by its logistic approximation (within 2e-4)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(z * 1.5976 + z * z * z * 0.070565992))


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), _upper_tail(F.least(F.abs(z), F.lit(30.0))) * 2)


def battery(code: Column, alphabet: str) -> Column:
    """The combined p-value of a string over `alphabet` (already folded to it)."""
    k, n = len(alphabet), F.length(code)
    halves = F.translate(code, alphabet, "0" * (k // 2) + "1" * (k - k // 2))
    counts = F.transform(F.array(*map(F.lit, alphabet)), lambda c: (n - F.length(F.replace(code, c, F.lit("")))).cast("double"))
    chi = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c) * k / n - n
    df = k - 1
    z_chi = (F.cbrt(F.greatest(chi, F.lit(0.0)) / df) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5
    ones = (n - F.length(F.replace(halves, F.lit("1"), F.lit("")))).cast("double")
    zeros = n - ones
    runs = F.regexp_count(halves, F.lit("01")) + F.regexp_count(halves, F.lit("10")) + 1
    mean = ones * zeros * 2 / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = F.when(spread > 0, _two_sided((runs - mean) / F.sqrt(F.greatest(spread, F.lit(1e-9))))).otherwise(F.lit(0.0))
    numbers = F.transform(F.filter(F.split(code, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - F.lit((k + 1) / 2))
    later = F.zip_with(F.slice(numbers, F.lit(1), n - 1), F.slice(numbers, F.lit(2), n - 1), lambda a, b: a * b)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    squares = total(F.transform(numbers, lambda x: x * x))
    p_serial = F.when(squares > 0, _two_sided(total(later) / F.greatest(squares, F.lit(1e-9)) * F.sqrt(n.cast("double")))).otherwise(F.lit(0.0))
    # pairs of equal symbols against Poisson: the tail of a gamma distribution, by the same approximation
    pairs = F.greatest((chi + n) * n / (2.0 * k) - n / 2.0, F.lit(0.5))
    expected = (n * (n - 1)).cast("double") / (2 * k)
    z_pairs = -F.sqrt(pairs) * 3 * (F.cbrt(expected / pairs) - 1 + F.lit(1 / 9) / pairs)
    z_chi = F.when(n < k, F.when(pairs > 0.6, z_pairs).otherwise(F.lit(-30.0))).otherwise(z_chi)
    p_chi = _upper_tail(F.least(F.greatest(z_chi, F.lit(-30.0)), F.lit(30.0)))
    return F.least(F.lit(1.0), F.least(p_chi, p_runs, p_serial) * 3)


def _judged(hit: Column) -> Column:
    """struct<enc: int, len: int, p: double> of a candidate."""
    folded = {"decimal": hit, "hex": F.lower(hit), "letters": F.lower(hit), "base36": F.lower(hit), "mixed": hit, "base64": F.translate(hit, "-_", "+/")}
    enc, p = F.lit(len(ENCODINGS) - 1), battery(folded["base64"], ENCODINGS[-1][2])
    for at, (name, pattern, alphabet) in reversed(list(enumerate(ENCODINGS[:-1]))):
        fits = hit.rlike(f"^(?:{pattern})$")
        enc, p = F.when(fits, F.lit(at)).otherwise(enc), F.when(fits, battery(folded[name], alphabet)).otherwise(p)
    size = F.lit(0)
    for at, least in enumerate(LENGTHS):
        size = F.when(F.length(hit) >= least, F.lit(at)).otherwise(size)
    return F.struct(enc.alias("enc"), size.alias("len"), p.alias("p"))


def _kept(rank: int, kind: str, keep) -> Column:
    spans = located(F.col(f"__m_{kind}"), F.col(f"__g_{kind}"))
    spans = F.filter(spans, keep) if keep else spans
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    return F.when(F.size(F.col(f"__m_{kind}")) > 0, spans).otherwise(F.array().cast(_SPANS))


def judged_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`, from one pass over the texts: __id, base (spans of the known shapes), random (array<struct<start, end, enc, len, p>> of all candidates)."""
    t = F.col("__text")
    rows = docs.select(column(id_col).alias("__id"), text_or_empty(text_col).alias("__text"))
    plan = {"assign": (ASSIGN, t.rlike(ASSIGN)), "access": (ACCESS, t.contains("AKIA")), "hex": (HEX, t.rlike("[0-9a-f]{32}")), "random": (RANDOM, t.rlike(RANDOM))}
    rows = rows.select("*", *[matches(t, p, when).alias(f"__m_{k}") for k, (p, when) in plan.items()], matches(t, ASSIGN, plan["assign"][1], 1).alias("__values"))
    rows = rows.select("*", *[gaps(t, p, F.col(f"__m_{k}")).alias(f"__g_{k}") for k, (p, _) in plan.items()])
    keep = {"assign": lambda s: F.length(F.get(F.col("__values"), s["at"])) >= 8}
    base = F.concat(*[_kept(rank, kind, keep.get(kind)) for rank, kind in enumerate(["assign", "access", "hex"])])
    judged = F.transform(located(F.col("__m_random"), F.col("__g_random")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _judged(s["hit"]).alias("j")))
    judged = F.transform(judged, lambda s: F.struct(s["start"], s["end"], s["j"]["enc"].alias("enc"), s["j"]["len"].alias("len"), s["j"]["p"].alias("p")))
    none = F.array().cast("array<struct<start:bigint,end:bigint,enc:int,len:int,p:double>>")
    return rows.select("__id", base.alias("base"), F.when(F.size("__m_random") > 0, judged).otherwise(none).alias("random"))


def levels(judged: DataFrame, fdr: float = FDR) -> dict[tuple[int, int], float]:
    """The level of acceptance by (encoding, class of length) of `judged_spans`; absent where no level keeps the share of false discoveries."""
    bins = judged.select(F.explode("random").alias("j")).groupBy(F.col("j.enc").alias("enc"), F.col("j.len").alias("len"), F.least(F.floor(F.col("j.p") * 100), F.lit(99)).cast("int").alias("bin")).count().collect()
    tables: dict[tuple[int, int], list[int]] = {}
    for enc, size, b, n in bins:
        tables.setdefault((enc, size), [0] * 100)[b] += n
    out = {}
    for key, table in tables.items():
        if sum(table[round(ALONE * 100) :]) < FEW:
            out[key] = ALONE
            continue
        random = 2 * sum(table[50:])
        for level in LEVELS:
            accepted = sum(table[round(level * 100) :])
            if accepted and 1 - min(1.0, random * (1 - level) / accepted) <= fdr:
                out[key] = level
                break
    return out


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """One row per row of `docs`: its id and `spans`, array<struct<start, rank, end, kind>>, kinds assign, access, hex, random.

    Starts and ends count code points, ends are exclusive. A random span may stand inside one of another kind.
    Null texts count as empty; repeated rows are kept; other columns of `docs` are ignored. The spans of all
    candidates, a small part of the texts, are kept as a table of the shared folder between the two steps.
    """
    judged = cut_lineage(judged_spans(docs, id_col, text_col), "secrets")
    accepted = levels(judged, fdr)
    if not accepted:
        return judged.select("__id", F.col("base").alias("spans"))
    level = F.create_map(*[F.lit(x) for (enc, size), v in sorted(accepted.items()) for x in (enc * 100 + size, v)])
    random = F.filter("random", lambda s: s["p"] >= F.coalesce(F.try_element_at(level, s["enc"] * 100 + s["len"]), F.lit(2.0)))
    random = F.transform(random, lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("rank"), s["end"].alias("end"), F.lit("random").alias("kind")))
    return judged.select("__id", F.concat("base", random).alias("spans"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """Counts and digests of secret_spans: the id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    spans = F.col("spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return secret_spans(docs, id_col, text_col, fdr).select(
        F.col("__id").alias(id_col),
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(digest(F.filter(spans, lambda s: s["rank"] < 3)), 256).alias("base_sha256"),
        digest(spans).alias("spans"),
        count("random").alias("n_random"),
    )


def op7_secrets(spark, sf_dir):
    return secret_scan(load(spark, sf_dir, "documents"))
