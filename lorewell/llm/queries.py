"""The registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import sql
from lorewell.llm.decontaminate import op7_decontaminate
from lorewell.llm.jaccard import op3_jaccard
from lorewell.llm.language import op5_language
from lorewell.llm.language_model import op9_lm_score
from lorewell.llm.licenses import op6_licenses
from lorewell.llm.mixing import op1_mixing
from lorewell.llm.pages import op13_pages
from lorewell.llm.pii import op10_pii
from lorewell.llm.quality import op8_quality
from lorewell.llm.substrings import op4_substrings
from lorewell.llm.toxicity import op2_toxicity
from lorewell.llm.turns import op11_turns
from lorewell.llm.whitening import op12_whitening


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of the quality rules, without the learnt verdict."""
    return op8_quality(spark, sf_dir).drop("kept")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of the language model's scores."""
    return op9_lm_score(spark, sf_dir).withColumn("base_score", F.round("base_score", 3)).drop("score", "token_score")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base kinds of personal data, without the method's own spans."""
    return op10_pii(spark, sf_dir).drop("spans", "n_spans")


def whitening_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact columns of the whitened embeddings, of the first component."""
    return op12_whitening(spark, sf_dir).where("component = 1").select("vec_id", "n", "deviation")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_jaccard": op3_jaccard,
    "op4_substrings": op4_substrings,
    "op5_language": op5_language,
    "op6_licenses": op6_licenses,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality": op8_quality,
    "op9_lm_score": op9_lm_score,
    "op10_pii": op10_pii,
    "op11_turns": op11_turns,
    "op12_whitening": op12_whitening,
    "op13_pages": op13_pages,
    "quality_base": quality_base,
    "lm_base": lm_base,
    "pii_base": pii_base,
    "whitening_base": whitening_base,
}

#: Learnt, sketched or searched results have no SQL form; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {"op7_decontaminate": sql.DECONTAMINATE, "quality_base": sql.QUALITY, "lm_base": sql.LM, "pii_base": sql.PII, "op11_turns": sql.TURNS, "whitening_base": sql.WHITENING}
