"""Quality rules: learned decision lists over text statistics, as ordered conditional expressions.

Native: statistics and verdict are Spark expressions in one pass over the
documents, without a shuffle or Python on the workers. Repeated windows are
found inside the row: most texts have none, which a distinct count of window
hashes shows; the others sort (hash, place) pairs, so the cost grows as n log n
with the text.

The list is learnt on the driver from the statistics (numbers, not texts) of at
most `max_train_docs` labelled rows, those with the smallest hash of their id.
Sequential covering: each rule is grown on two thirds of the rows, one threshold
at a time by FOIL gain, pruned on the rest from its last condition backward, and
accepted while it drops mostly bad rows of the rest; the rows that it covers
leave. What no rule covers is kept.

Edge cases: a null text has no words and fails the base rule, as does an empty
one; labels that are null or of missing documents are not learnt from; several
labels of a document count with the smallest, and of rows with the same doc_id one; without labels of both kinds the
list is empty and the base rule alone decides; repeated rows are judged each;
empty tables give an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import common

#: What rules are made of, in the order of the statistics columns.
FEATURES = ("n_words", "mean_word", "symbols_a_word", "dup_line_share", "repeat_share", "upper_share", "marks_a_word", "digit_share")


@dataclass(frozen=True)
class QualityParams:
    #: Bound on the labelled rows whose statistics are learnt from.
    max_train_docs: int = 20_000
    thresholds: int = 48
    max_rules: int = 12
    max_conditions: int = 4
    #: A rule must be right for this share of the pruning rows that it covers.
    min_precision: float = 0.8
    min_covered: int = 5


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.threshold if self.above else c <= self.threshold

    def holds(self, x: np.ndarray) -> np.ndarray:
        c = x[:, FEATURES.index(self.feature)]
        return c > self.threshold if self.above else c <= self.threshold


Rule = tuple[Condition, ...]


def statistics(documents: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep`, the base counts and the shares that rules use, from whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    one = documents.select(
        *keep,
        text.alias("_text"),
        F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    without = lambda pattern: (F.length("_text") - F.length(F.regexp_replace("_text", pattern, ""))).cast("long")
    windows = lambda words: F.transform(F.sequence(F.lit(1), F.size(words) - 4), lambda i: F.xxhash64(F.slice(words, i, 5)))
    two = one.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_words")).cast("long").alias("word_chars"),
        without(r"[#*$%&|<>]").alias("n_symbols"),
        F.size("_lines").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        without(r"\p{Lu}").alias("_upper"), without(r"[!?|]").alias("_marks"), without("[0-9]").alias("_digits"),
        F.when(F.size("_words") >= 5, common.let(common.let(F.col("_words"), windows), _repeated)).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return two.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / words).alias("mean_word"), (F.col("n_symbols") / words).alias("symbols_a_word"),
        (F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1))).alias("dup_line_share"), (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("_upper") / chars).alias("upper_share"), (F.col("_marks") / words).alias("marks_a_word"), (F.col("_digits") / chars).alias("digit_share"),
    )


def _repeated(windows: Column) -> Column:
    """Words that lie in a 5-word window which is in the text twice or more, from the windows' hashes."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def starts(ordered: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(ordered, j)["h"] == x["h"], F.lit(False))
        marked = F.transform(ordered, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["p"]))
        return F.array_sort(F.array_compact(marked))

    first = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(common.let(pairs, starts), first, lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(5), p - s["last"])).alias("n")), lambda s: s["n"])
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered).otherwise(F.lit(0))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _foil(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1.0)


def _grow(x: np.ndarray, bad: np.ndarray, grid: list[np.ndarray], p: QualityParams) -> Rule:
    """Adds the threshold of the largest gain until only bad rows are left or nothing is gained."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < p.max_conditions:
        p0, n0 = float((inside & bad).sum()), float((inside & ~bad).sum())
        if not p0 or not n0:
            break
        best: tuple[float, Condition | None] = (1e-9, None)
        for k, feature in enumerate(FEATURES):
            place = np.searchsorted(grid[k], x[inside, k], "left")  # x > grid[t] for t < place
            up = lambda y: np.cumsum(np.bincount(place[y], minlength=len(grid[k]) + 1)[::-1])[::-1][1:]  # noqa: E731, B023
            pos, neg = up(bad[inside]).astype(float), up(~bad[inside]).astype(float)
            for above, a, b in ((True, pos, neg), (False, p0 - pos, n0 - neg)):
                gain = _foil(a, b, p0, n0)
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), Condition(feature, above, float(grid[k][gain.argmax()])))
        if best[1] is None:
            break
        found, column = best[1], x[inside, FEATURES.index(best[1].feature)]
        # halfway to the next value seen: rows not seen yet should not turn on the last one
        rule.append(Condition(found.feature, found.above, (found.threshold + float(column[column > found.threshold].min(initial=np.inf))) / 2 if (column > found.threshold).any() else found.threshold))
        inside &= rule[-1].holds(x)
    return tuple(rule)


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(x) for c in rule), np.ones(len(x), bool))


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The shortest beginning of the rule with the best (right - wrong) / covered."""
    worth = []
    for size in range(1, len(rule) + 1):
        inside = covers(rule[:size], x)
        worth.append(((2 * (inside & bad).sum() - inside.sum()) / max(1, inside.sum()), -size))
    return rule[: -max(worth)[1]] if worth else rule


def learn(x: np.ndarray, bad: np.ndarray, p: QualityParams = QualityParams()) -> list[Rule]:
    """An ordered list of rules, each a conjunction whose rows are to be dropped."""
    rules: list[Rule] = []
    grow = np.arange(len(x)) % 3 != 0
    while len(rules) < p.max_rules and (bad & grow).any() and (~bad).any():
        grid = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, p.thresholds + 2)[1:-1])) for k in range(len(FEATURES))]
        extra = [np.unique(np.quantile(x[bad, k], np.linspace(0, 1, p.thresholds))) for k in range(len(FEATURES))]
        rule = _prune(_grow(x[grow], bad[grow], [np.union1d(a, b) for a, b in zip(grid, extra)], p), x[~grow], bad[~grow])
        if not rule:
            break
        inside = covers(rule, x)
        test = inside & ~grow
        if (inside & bad).sum() < p.min_covered or (test & bad).sum() < p.min_precision * max(1, test.sum()):
            break
        rules.append(rule)
        x, bad, grow = x[~inside], bad[~inside], grow[~inside]
    return rules


def fit(documents: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> list[Rule]:
    """Learns from `labels` (doc_id, quality), at most `max_train_docs` of them."""
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_train_docs).select(F.col("doc_id").alias("k"), "quality")
    )
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("k"))
    # a doc_id that repeats is learnt from once, so that rows are bounded as ids are
    one = statistics(rows, "k", "quality").groupBy("k").agg(F.min(F.struct("quality", base_failed().alias("failed"), *FEATURES)).alias("row")).select("k", "row.*")
    found = [r for r in one.collect() if not r[2]]
    found.sort(key=lambda r: (r.k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, *r[1:]))
    x = np.array([r[3:] for r in found], float).reshape(-1, len(FEATURES))
    return learn(x, np.array([r.quality == 0 for r in found], bool), p)


def verdict(rules: list[Rule]) -> Column:
    """The first rule that holds drops the row; without one it is kept."""
    tests = [reduce(lambda a, b: a & b, (c.column() for c in rule)) for rule in rules]
    return reduce(lambda chain, test: chain.when(test, False), tests[1:], F.when(tests[0], False)).otherwise(True) if tests else F.lit(True)


def judge(documents: DataFrame, rules: list[Rule], *keep: str) -> DataFrame:
    return statistics(documents, *keep).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op8_quality(spark: SparkSession, sf_dir: str, params: QualityParams = QualityParams()) -> DataFrame:
    """Judges every document."""
    documents = common.read_table(spark, sf_dir, "documents")
    rules = fit(documents, common.read_table(spark, sf_dir, "labels"), params)
    return judge(documents, rules, "doc_id").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
