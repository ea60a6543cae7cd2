"""Parsing of a model's query variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorewell.functions.text import let, trim_ws


def parse_expansion(raw: Column, n: int) -> Column:
    """Up to n variants from a JSON list, fenced or inside other text, else from lines without bullets and quotes."""
    body = trim_ws(raw)
    fenced = F.when(body.contains("```"), trim_ws(F.regexp_extract(body, r"(?s)```(?:json)?(.*?)(?:```|\z)", 1))).otherwise(body)
    listed = F.regexp_extract(fenced, r"(?s)\[.*\]", 0)
    lines = F.transform(F.split(raw, "\n"), lambda x: F.regexp_replace(F.regexp_replace(trim_ws(x), r"\A[-*•0-9.、)） ]+", ""), "\\A[\"'「」]+|[\"'「」]+\\z", ""))
    lines = F.filter(lines, lambda x: ~x.startswith("```"))
    some = lambda a: F.slice(F.filter(F.transform(a, trim_ws), lambda x: x != ""), 1, n)
    return let(F.from_json(F.when(listed != "", listed), "array<string>"), lambda j: some(F.coalesce(j, lines)))
