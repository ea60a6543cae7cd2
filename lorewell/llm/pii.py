"""PII: patterns propose spans, checksums confirm them, nearby words adjust the score.

Native: every step is a Spark expression inside the row; there is no shuffle and
no Python on the workers. A pattern is applied twice, once for what matches and
once for the pieces between; the lengths of both, added up, give each match's
place in code points. Possessive quantifiers keep every pattern linear in the
text and free of recursion, so one very long word or number is harmless.

Base kinds (email, ip, card, phone) are always reported once their check holds.
Further kinds need a score. Two find what a base pattern loses by running on
into the next number: telephone numbers with an area code in brackets, and card
numbers in four groups. An IBAN passes mod-97, an access key its form, and a
national number (3-2-4 digits) needs a word such as "ssn" within `context`
characters.

Edge cases: a null or empty text has no span; of matches that overlap within a
kind the leftmost counts; spans of different kinds may overlap and are all
reported; repeated rows are searched each; an empty table gives an empty
result. Columns beside the text pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import common

_NUMBER = "regexp_replace(m, '[^0-9]', '')"
_LUHN = (
    "transform(array({d}), d -> length(d) BETWEEN 16 AND 19 AND aggregate(sequence(1, length(d)), 0, (s, i) -> s + "
    "transform(array(int(substr(d, length(d) - i + 1, 1))), x -> CASE WHEN i % 2 = 1 THEN x WHEN x > 4 THEN 2 * x - 9 ELSE 2 * x END)[0]) % 10 = 0)[0]"
).format(d=_NUMBER)
_MOD97 = (
    "transform(array(replace(m, ' ', '')), d -> length(d) BETWEEN 15 AND 34 AND aggregate(split(concat(substr(d, 5), substr(d, 1, 4)), ''), 0, (s, c) -> "
    "CASE WHEN c = '' THEN s WHEN c BETWEEN '0' AND '9' THEN (s * 10 + int(c)) % 97 ELSE (s * 100 + ascii(c) - 55) % 97 END) = 1)[0]"
)
_OCTETS = "forall(split(m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(p AS DECIMAL(38, 0)), 0) <= 255)"


@dataclass(frozen=True)
class Kind:
    name: str
    #: A text that lacks this has no match; cheap to see.
    hint: str
    pattern: str
    #: SQL over the match m; true confirms it.
    check: str
    #: Words nearby that raise the score, as a pattern.
    words: str
    base: bool
    score: float
    #: The base kind that it completes: a span inside one of that kind is not reported again.
    completes: str = ""


# fixed values: the kinds in the order in which they are reported
KINDS = (
    Kind("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true", "mail|contact|write", True, 0.7),
    Kind("ip", ".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _OCTETS, r"\bip\b|address|host|server", True, 0.6),
    Kind("card", "", r"[0-9](?:[\x20-]?[0-9])++", _LUHN, "card|visa|credit|payment", True, 0.8),
    Kind("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_NUMBER}) BETWEEN 8 AND 15", "phone|call|tel|mobile|fax", True, 0.6),
    Kind("tel", "+", r"\+[0-9]{1,3}[\x20-]?\([0-9]{2,4}\)[\x20-]?[0-9]{3,4}[\x20-]?[0-9]{4}(?![0-9])", "true", "phone|call|tel|mobile|fax", False, 0.6, "phone"),
    Kind("pan", "", r"(?<![0-9])(?<![0-9]-)[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])", _LUHN, "card|visa|credit|payment", False, 0.8, "card"),
    Kind("iban", "", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", _MOD97, "iban|bank|account|konto", False, 0.8),
    Kind("key", "AKIA", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])", "true", "aws|key|secret|token", False, 0.7),
    Kind("ssn", "-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "NOT (m LIKE '000%' OR m LIKE '666%' OR m LIKE '9%')", r"\bssn\b|social security", False, 0.3),
)
_SPAN = "struct<start:bigint,end:bigint,value:string,score:double>"


@dataclass(frozen=True)
class PiiParams:
    context: int = 40
    #: Further kinds are reported from this score on; a word nearby adds `boost`.
    threshold: float = 0.5
    boost: float = 0.2


def _cut(k: Kind, text: Column) -> tuple[Column, Column]:
    """Pieces between the matches and the matches; nothing where the hint is missing."""
    seen = text.contains(k.hint) if k.hint else text.rlike("[0-9]{2}" if k.name == "iban" else r"[0-9](?:[\x20-]?[0-9]){15}")
    none = F.array().cast("array<string>")
    return F.when(seen, F.split(text, k.pattern)).otherwise(none), F.when(seen, F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))).otherwise(none)


def _spans(k: Kind, p: PiiParams) -> Column:
    """Start, end, value and score of each confirmed match of a kind.

    Lengths add up over runs of 256 matches, so that many matches in one text
    cost no square of their number.
    """
    step = f"""struct(s.at + length(z.p[i]) + length(z.m[i]) AS at, concat(s.out, array(struct(
        s.at + length(z.p[i]) AS start, s.at + length(z.p[i]) + length(z.m[i]) AS end, z.m[i] AS value,
        CASE WHEN transform(array(z.m[i]), m -> {k.check})[0] THEN {_score(k, p)} ELSE -1D END AS score))) AS out)"""
    run = f"aggregate(sequence(c * 256, least(size(z.m), (c + 1) * 256) - 1), struct(t.at AS at, CAST(array() AS array<{_SPAN}>) AS out), (s, i) -> {step})"
    every = f"""aggregate(sequence(0, (size(z.m) - 1) div 256), struct(0L AS at, CAST(array() AS array<array<{_SPAN}>>) AS runs),
        (t, c) -> transform(array({run}), r -> struct(r.at AS at, concat(t.runs, array(r.out)) AS runs))[0], t -> flatten(t.runs))"""
    least = 0.0 if k.base else p.threshold
    found = f"CASE WHEN size(z.m) > 0 THEN filter({every}, x -> x.score >= {least}D) ELSE CAST(array() AS array<{_SPAN}>) END"
    # z holds the pieces and matches: computed once, wherever the optimiser moves the expression
    return F.expr(f"transform(array(struct(_p_{k.name} AS p, _m_{k.name} AS m)), z -> {found})[0]")


def _score(k: Kind, p: PiiParams) -> str:
    """SQL for the score of match i of z: its kind's, and more if a fitting word is near."""
    near = f"concat(right(z.p[i], {p.context}), ' ', left(z.p[i + 1], {p.context})) RLIKE '(?i){k.words.replace(chr(92), chr(92) * 2)}'"
    return f"least(1D, {k.score}D + CASE WHEN {near} THEN {p.boost}D ELSE 0D END)"


def find_pii(documents: DataFrame, params: PiiParams = PiiParams(), text: str = "text") -> DataFrame:
    """All columns, and for each kind k an array `_k` of (start, end, value, score); underscores are added where that name is taken."""
    plain, names = common.renamed(documents)
    body = F.coalesce(F.col(names[documents.columns.index(text)]), F.lit(""))
    cut = plain.select("*", *(c.alias(f"{a}_{k.name}") for k in KINDS for a, c in zip(("_p", "_m"), _cut(k, body))))
    found = cut.select(*names, *(_spans(k, params).alias(f"_{k.name}") for k in KINDS))
    alone = "filter(_{n}, x -> NOT exists(_{b}, y -> y.start <= x.start AND x.end <= y.end)) AS _{n}"
    out = found.selectExpr(*names, *(alone.format(n=k.name, b=k.completes) if k.completes else f"_{k.name}" for k in KINDS))
    return out.toDF(*documents.columns, *common.free_names((f"_{k.name}" for k in KINDS), documents.columns))


def _listed(kinds: tuple[Kind, ...]) -> Column:
    return F.expr("array_join(concat(" + ", ".join(f"transform(_{k.name}, x -> concat('{k.name}:', x.start, ':', x.end))" for k in kinds) + "), ',')")


def redact(documents: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """The same columns, each span replaced by its kind in brackets and n_chars, if any, counted anew.

    Kinds are replaced one after the other, so what overlaps goes with the first.
    """
    plain, names = common.renamed(documents)
    body = names[documents.columns.index("text")]
    for k in sorted(KINDS, key=lambda k: ("email", "tel", "phone", "pan", "card", "iban", "ip", "key", "ssn").index(k.name)):
        pieces, matches = _cut(k, F.col(body))
        cut = plain.select(*names, pieces.alias(f"_p_{k.name}"), matches.alias(f"_m_{k.name}"))
        sure = "true" if k.base else f"{_score(k, params)} >= {params.threshold}D"
        new = F.expr(f"""CASE WHEN size(_m_{k.name}) > 0 THEN transform(array(struct(_p_{k.name} AS p, _m_{k.name} AS m)), z -> concat(array_join(transform(z.m, (m, i) ->
            concat(z.p[i], CASE WHEN {k.check} AND {sure} THEN '[{(k.completes or k.name).upper()}]' ELSE m END)), ''), element_at(z.p, -1)))[0] ELSE {body} END""")
        plain = cut.select(*(new.alias(c) if c == body else F.col(c) for c in names))
    if "n_chars" in documents.columns:
        count = names[documents.columns.index("n_chars")]
        kind = documents.schema["n_chars"].dataType
        plain = plain.withColumn(count, F.when(F.col(body).isNull(), F.col(count)).otherwise(F.length(body)).cast(kind))
    return plain.toDF(*documents.columns)


def op10_pii(spark: SparkSession, sf_dir: str, params: PiiParams = PiiParams()) -> DataFrame:
    """Finds personal data in every document."""
    found = find_pii(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"), params)
    base = tuple(k for k in KINDS if k.base)
    return found.select(
        "doc_id", *(F.size(f"_{k.name}").cast("long").alias(f"n_{k.name}") for k in base),
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(KINDS).alias("spans"),
        sum((F.size(f"_{k.name}") for k in KINDS), F.lit(0)).cast("long").alias("n_spans"),
    )
