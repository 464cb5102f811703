"""Where a regular expression matches, as columns: DataFrame functions only.

Spark's functions return what matched (``regexp_extract_all``) or what stands between the matches
(``split``), never positions. Both walk a text with the same matcher, so the running lengths of gaps and
matches give each match's place in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: str, when: Column | None = None, group: int = 0) -> Column:
    """All leftmost, non-overlapping matches; an empty array where `when` (a cheap necessary condition) is false."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return found if when is None else F.when(when, found).otherwise(F.array().cast("array<string>"))


def gaps(text: Column, pattern: str, found: Column) -> Column:
    return F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))


def located(found: Column, between: Column) -> Column:
    """array<struct<start: long, end: long, hit: string, at: int>>; starts count from 0, ends are exclusive.

    One pass over the matches of a text: the running place and the spans so far are folded along.
    """
    none = F.array().cast("array<struct<start:bigint,end:bigint,hit:string,at:int>>")
    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("size"), m.alias("hit")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["place"] + x["gap"]
        one = F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["hit"].alias("hit"), F.size(acc["spans"]).alias("at"))
        return F.struct((start + x["size"]).alias("place"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    folded = F.aggregate(pairs, F.struct(F.lit(0).cast("long").alias("place"), none.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(F.size(found) > 0, folded).otherwise(none)


def before(text: Column, start: Column, width: int) -> Column:
    """Up to `width` characters that stand before a span."""
    return text.substr((F.greatest(start - width, F.lit(0)) + 1).cast("int"), F.least(start, F.lit(width)).cast("int"))


def after(text: Column, end: Column, width: int) -> Column:
    """Up to `width` characters that stand behind a span."""
    return text.substr((end + 1).cast("int"), F.lit(width))


def digest(spans: Column) -> Column:
    """'kind:start:end' of spans (structs with start, rank, end, kind), by start, then rank."""
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
