"""Citations in answers: check, clean, filter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorewell.functions.text import let, trim_ws

_MARK = r"\[([0-9]+)\]"


def _numbers(answer: Column) -> Column:
    """Cited numbers; one too large for an int counts as out of range."""
    return F.transform(F.regexp_extract_all(answer, F.lit(_MARK), F.lit(1)), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(9223372036854775807).cast("bigint")))


def _valid(n: Column, sources: Column) -> Column:
    return (n >= 1) & (n <= sources)


def check(answer: Column, sources: Column) -> Column:
    """struct(answer, valid, removed, changed): citations outside 1..sources go, and the gaps they leave."""

    def build(numbers: Column) -> Column:
        pieces = F.split(answer, r"\[[0-9]+\]")
        kept = F.transform(numbers, lambda n: F.when(_valid(n, sources), F.concat(F.lit("["), n.cast("string"), F.lit("]"))).otherwise(""))
        text = F.array_join(F.zip_with(pieces, F.concat(kept, F.array(F.lit(""))), lambda p, k: F.concat(p, k)), "")
        for old, new in (("  ", " "), (" 。", "。"), (" ，", "，"), (" 、", "、")):
            text = F.replace(text, F.lit(old), F.lit(new))
        valid = F.array_sort(F.array_distinct(F.filter(numbers, lambda n: _valid(n, sources))))
        removed = F.array_sort(F.array_distinct(F.filter(numbers, lambda n: ~_valid(n, sources))))
        return let(trim_ws(text), lambda s: F.struct(s.alias("answer"), valid.alias("valid"), removed.alias("removed"), ((s != answer) | (F.size(removed) > 0)).alias("changed")))

    none = F.array().cast("array<bigint>")
    unchanged = F.struct(answer.alias("answer"), none.alias("valid"), none.alias("removed"), F.lit(False).alias("changed"))
    return F.when(answer.contains("["), let(_numbers(answer), build)).otherwise(unchanged)


def cited_sources(sources: Column, cited: Column) -> Column:
    """The sources whose 1-based place is cited; all of them if none is."""
    kept = F.filter(sources, lambda _, i: F.array_contains(cited, (i + 1).cast("bigint")))
    return F.when(F.size(kept) > 0, kept).otherwise(sources)
