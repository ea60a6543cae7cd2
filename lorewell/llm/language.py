"""Language ID by rank-order profiles (out-of-place distance).

A profile is the `profile_size` most frequent character n-grams (n = 1 to 3,
over lower-cased letters, words padded by a space) of a language, counted over
every training text. A text's own most frequent n-grams are ranked the same
way; the distance to a language is the sum of rank differences, with
`profile_size` for an n-gram that the profile lacks. An n-gram of up to three
code points is one exact 64-bit number, so counting is sorting.

Counts are summed within each task before the only shuffle, which is of n-gram
counts by language, not of texts. The profiles are languages x profile_size
numbers, bounded by `max_languages`.

Edge cases: a null text or one without a letter gets `und` and score 0; with no
profile at all every text gets `und`; equal counts are ranked by code point,
equal distances go to the first language name; a null lang is not learnt from;
an empty table gives an empty result. Only text, lang and the id are read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.llm import common

_BITS = 21  # of a code point
_SPACE = 1


@dataclass(frozen=True)
class LanguageParams:
    profile_size: int = 300
    #: More distinct lang values than this are refused; bounds the profiles that are broadcast.
    max_languages: int = 500


_made: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Code point to its lower-case letter, or to the space."""
    if "letters" in _made:
        return _made["letters"]
    table = np.full(0x110000, _SPACE, np.int64)
    for c in range(0x20000):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
        elif unicodedata.category(chr(c))[0] == "M":
            table[c] = c  # marks are parts of words
    table[0x20000:0x323B0] = np.arange(0x20000, 0x323B0)  # ideographs beyond the first planes
    _made["letters"] = table
    return table


def _alphabetic() -> np.ndarray:
    """Which code points are letters; a text without any is of no language, whatever marks it has."""
    if "alphabetic" not in _made:
        table = np.zeros(0x110000, bool)
        table[:0x20000] = [chr(c).isalpha() for c in range(0x20000)]
        table[0x20000:0x323B0] = True
        _made["alphabetic"] = table
    return _made["alphabetic"]


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram) of every position of every text, n = 1 to 3."""
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.cumsum(np.concatenate([[0], ((data & 0xC0) != 0x80).astype(np.int64)]))[offsets]
    n = len(starts) - 1
    own = np.repeat(np.arange(n), np.diff(starts))
    letter = _letters()[chars]
    # a space before each text; runs of spaces become one
    place = np.arange(len(letter)) + own + 1
    padded = np.full(len(letter) + n + 1, _SPACE, np.int64)
    padded[place] = letter
    text = np.zeros(len(padded), np.int64)
    text[place] = own
    text[starts[:-1] + np.arange(n)] = np.arange(n)
    text[-1] = n - 1
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != _SPACE) | (padded[:-1] != _SPACE)
    padded, text = padded[keep], text[keep]
    word = padded != _SPACE
    two = padded[:-1] << _BITS | padded[1:]
    three = two[:-1] << _BITS | padded[2:]
    inner = word[1:-1]  # a trigram around a space spans two words
    pair = np.where(word[1:], text[1:], text[:-1])  # a pair is its letter's, also where the space is the next text's
    return np.concatenate([text[word], pair, text[1:-1][inner]]), np.concatenate([padded[word], two, three[inner]])


def _top(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first."""
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    count = np.diff(np.append(first, len(codes)))
    return codes[first][np.argsort(-count, kind="stable")[:size]]


def profiles(documents: DataFrame, params: LanguageParams = LanguageParams()) -> DataFrame:
    """(lang, gram, rank from 0) of the most frequent n-grams of every non-null lang, from all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            code, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return code, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)

        for part in common.slices(batches):
            names = part.column("lang").to_pylist()
            text, gram = _grams(*common.text_arrays(part.column("text")))
            for name in dict.fromkeys(names):
                mine = np.array([x == name for x in names])
                parts = held.setdefault(name, [])
                parts.append(np.unique(gram[mine[text]], return_counts=True))
                if len(parts) > 8:
                    held[name] = [merged(parts)]
        for name, parts in held.items():
            code, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.string()), pa.array(code), pa.array(n)], ["lang", "gram", "n"])

    rows = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counted = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # the filter on the rank is pushed into the sort of each task, so a language is not gathered whole
    return counted.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < params.profile_size).select("lang", "gram", "rank")


def predict(documents: DataFrame, ranks: DataFrame, params: LanguageParams = LanguageParams()) -> DataFrame:
    """doc_id, lang_pred and score (1 - distance / largest possible distance) of each whole text."""
    found = ranks.limit(params.max_languages * params.profile_size + 1).collect()
    if len(found) > params.max_languages * params.profile_size:
        raise ValueError(f"more than {params.max_languages} languages")
    names = sorted({r.lang for r in found})
    grams = np.unique(np.array([r.gram for r in found], np.int64))
    size = params.profile_size
    table = np.full((len(grams) + 1, max(1, len(names))), -1, np.int32)  # the last row: in no profile
    at = {name: k for k, name in enumerate(names)}
    for r in found:
        table[np.searchsorted(grams, r.gram), at[r.lang]] = r.rank
    spread = documents.sparkSession.sparkContext.broadcast((names, grams, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, grams, table = spread.value
        for part in common.slices(batches, limit=common.STEP_BYTES // 2):
            text, gram = _grams(*common.text_arrays(part.column("text")))
            order = np.argsort(text, kind="stable")
            gram, starts = gram[order], np.searchsorted(text[order], np.arange(part.num_rows + 1))
            pred, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
            for d in range(part.num_rows):
                own = gram[starts[d] : starts[d + 1]]
                if not names or not _alphabetic()[own[own >> _BITS == 0]].any():
                    continue
                top = _top(own, size)
                row = np.minimum(np.searchsorted(grams, top), len(grams) - 1)
                row[grams[row] != top] = len(grams)
                rank = table[row]
                distance = np.where(rank < 0, size, np.abs(rank - np.arange(len(top))[:, None])).sum(axis=0)
                best = int(distance.argmin())
                pred[d], score[d] = names[best], 1 - distance[best] / (size * len(top))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    schema = documents.select("doc_id").schema.add("lang_pred", "string").add("score", "double")
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def op5_language(spark: SparkSession, sf_dir: str, params: LanguageParams = LanguageParams()) -> DataFrame:
    """Predicts every document's language; crc32(doc_id) mod 3 = 1 is held out of learning."""
    documents = common.read_table(spark, sf_dir, "documents")
    ranks = profiles(documents.where(common.fold("doc_id", 3) != 1), params)
    return predict(documents, ranks, params).select("doc_id", (common.fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
