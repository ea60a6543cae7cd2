"""Golden cases from files of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorewell.operators.quality import golden_cases
from lorewell.sources.lines import SPLIT_BYTES, numbered, read_lines


def read_golden(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The cases of a file, as `golden_cases` has them; a file without any is an error. Lines are numbered across its splits."""
    cases = golden_cases(numbered(read_lines(spark, path, split_bytes)).select("line", "raw"))
    if cases.isEmpty():
        raise ValueError(f"no case in {path}")
    return cases
