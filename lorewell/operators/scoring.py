"""Scores of blocks of documents for a set of questions, as products of matrices in Arrow batches.

What a task sends on of a question is the documents that are among its k best so
far, so rows grow with questions and tasks, not with documents that share a word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lorewell.operators.vectors import best

#: Bytes of question terms that are broadcast; more are looked up by shuffle.
MAX_TERM_BYTES = 32 << 20
#: (question, term) pairs of one matrix of weights, and documents that it meets at once; both bound a worker's memory.
PAIRS = 8192
ROWS = 1024


@dataclass(frozen=True)
class Part:
    """Some questions: their places, their terms in order, and where a question's weight of a term is."""

    questions: np.ndarray
    terms: np.ndarray
    term_at: np.ndarray
    question_at: np.ndarray
    weight: np.ndarray

    def matrix(self, terms: np.ndarray) -> np.ndarray:
        """(terms, questions) for some of the terms, by their places in order."""
        out = np.zeros((len(self.terms), len(self.questions)))
        out[self.term_at, self.question_at] = self.weight
        return out[terms]


@dataclass(frozen=True)
class Weights:
    """Questions and the weights of their terms; terms are numbered in the order of `terms`."""

    ids: pa.Array
    terms: list[str]
    parts: list[Part]


def weights(query_ids: list, terms: list[str], weight: list[float], kind: pa.DataType | None = None) -> Weights:
    """From (query_id, term, weight) of each question's distinct terms."""
    ids = pa.array(query_ids, kind).dictionary_encode(null_encoding="encode")
    question = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
    names, code = np.unique(np.array(terms, object), return_inverse=True) if len(terms) else (np.zeros(0, object), np.zeros(0, np.int64))
    order = np.lexsort((code, question))
    question, code, value = question[order], code[order], np.array(weight, np.float64)[order]
    starts = np.flatnonzero(np.r_[True, question[1:] != question[:-1]]) if len(question) else np.zeros(0, np.int64)
    ends, parts, first = np.r_[starts[1:], len(question)], [], 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + PAIRS, "right")))
        own = slice(starts[first], ends[last - 1])
        asked, question_at = np.unique(question[own], return_inverse=True)
        known, term_at = np.unique(code[own], return_inverse=True)
        parts.append(Part(asked, known, term_at, question_at, value[own]))
        first = last
    return Weights(ids.dictionary, list(names), parts)


class Top:
    """The k largest scores of each question that a task has seen; says which rows can still be among the k best of all."""

    def __init__(self, questions: int, k: int) -> None:
        self.k, self.seen = k, [np.zeros(0)] * questions
        self.least = np.zeros(questions)

    def take(self, question: int, scores: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Places of the rows to send on; `order` settles ties."""
        value = np.round(scores, 6)
        at = np.flatnonzero((scores > 0) & (value >= self.least[question]))
        at = at[best(value[at], order[at], self.k)]
        seen = np.concatenate([self.seen[question], value[at]])
        if len(seen) >= self.k:
            seen = np.sort(seen)[len(seen) - self.k :]
            self.least[question] = seen[0]
        self.seen[question] = seen
        return at


def send(w: Weights, top: Top, docs: pa.Array, row: np.ndarray, code: np.ndarray, value: np.ndarray, asked: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(query_id, doc_id, score) of the documents that may be among the best; entries (row, code, value) of a document and term add up.

    `asked` marks the questions to score, else all are.
    """
    ids = docs.dictionary_encode(null_encoding="encode").dictionary if len(docs) else docs
    if len(ids) != len(docs):
        raise ValueError("a document comes once in a block")
    order = np.empty(len(docs), np.int64)
    order[pc.sort_indices(docs, null_placement="at_start").to_numpy()] = np.arange(len(docs))
    for part in w.parts:
        wanted = np.arange(len(part.questions)) if asked is None else np.flatnonzero(asked[part.questions])
        place = np.minimum(np.searchsorted(part.terms, code), len(part.terms) - 1)
        fits = part.terms[place] == code
        if not len(wanted) or not fits.any():
            continue
        known, local = np.unique(place[fits], return_inverse=True)
        weight = part.matrix(known)[:, wanted]
        rows, values = row[fits], value[fits]
        for start in range(0, len(docs), ROWS):
            n = min(ROWS, len(docs) - start)
            own = (rows >= start) & (rows < start + n)
            block = np.bincount((rows[own] - start) * len(known) + local[own], values[own], n * len(known)).reshape(n, -1)
            scores = block @ weight
            which, at = [], []
            for q in np.flatnonzero((scores > 0).any(0) & (np.round(scores.max(0), 6) >= top.least[part.questions[wanted]])):
                found = top.take(part.questions[wanted[q]], scores[:, q], order[start : start + n])
                which.append(np.full(len(found), q))
                at.append(found)
            if which:
                which, at = np.concatenate(which), np.concatenate(at)
                yield pa.RecordBatch.from_arrays([w.ids.take(pa.array(part.questions[wanted[which]])), docs.take(pa.array(at + start)), pa.array(scores[at, which])], ["query_id", "doc_id", "score"])


def whole(batches: Iterable[pa.RecordBatch], key: str, rows: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows sorted by `key` in batches that end where a value ends, each of `rows` rows or more but the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) <= rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        column = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(column[1:] != column[:-1]) + 1
        if len(cut):
            done, rest = table.slice(0, cut[-1]), table.slice(cut[-1])
            yield done.combine_chunks().to_batches()[0]
            held = rest.to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
