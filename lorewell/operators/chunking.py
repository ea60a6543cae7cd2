"""Structure splitting and chunking of extracted text.

A text is cut into lines once; markers open sections, so a section is a running
count of marker lines and everything after is grouping inside the row's own
lines. Splitting is done with array functions per document: the lines of one
document never need a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.functions.text import let, trim_ws

# fixed values: section markers in extracted text, as whole lines
PAGE = r"(?md)^##\s*第\s*([0-9]+)\s*页\s*$"
SHEET = r"(?md)^##\s*工作表:\s*(.+?)\s*$"
HEADING = r"(?md)^#{1,6}\s+(.+?)\s*$"
_EMPTY = "array<struct<section:string,page:bigint,content:string>>"


def _cut(text: Column, marker: str) -> Column:
    """struct(titles, bodies): what each marker captured, and the text before, between and after them."""
    return F.struct(F.regexp_extract_all(text, F.lit(marker), F.lit(1)).alias("titles"), F.transform(F.split(text, marker), trim_ws).alias("bodies"))


def _sections(text: Column, marker: str, section) -> Column:
    """`section(title, body)` for each marker with a body; what precedes the first marker is dropped."""
    each = lambda z: F.filter(F.transform(z["titles"], lambda t, i: section(t, F.get(z["bodies"], i + 1))), lambda x: x["content"] != "")
    return let(_cut(text, marker), each)


def _row(section: Column, page: Column, content: Column) -> Column:
    return F.struct(section.alias("section"), page.alias("page"), content.alias("content"))


def by_pages(text: Column) -> Column:
    number = lambda t: t.try_cast("bigint")
    return _sections(text, PAGE, lambda t, b: _row(F.concat(F.lit("第 "), number(t).cast("string"), F.lit(" 页")), number(t), b))


def by_sheets(text: Column) -> Column:
    return _sections(text, SHEET, lambda t, b: _row(F.concat(F.lit("工作表: "), trim_ws(t)), F.lit(0).cast("bigint"), b))


def by_headings(text: Column) -> Column:
    """Title and body of every heading, the preamble without a title; nothing if there is at most one section."""

    def build(z: Column) -> Column:
        zero = F.lit(0).cast("bigint")
        body = lambda t, b: F.when(b == "", trim_ws(t)).otherwise(F.concat(trim_ws(t), F.lit("\n\n"), b))
        head = F.when((F.size(z["titles"]) > 0) & (F.get(z["bodies"], F.lit(0)) != ""), F.array(_row(F.lit(""), zero, F.get(z["bodies"], F.lit(0))))).otherwise(F.array().cast(_EMPTY))
        rest = F.transform(z["titles"], lambda t, i: _row(trim_ws(t), zero, body(t, F.get(z["bodies"], i + 1))))
        return let(F.concat(head, rest), lambda a: F.when(F.size(a) > 1, a).otherwise(F.array().cast(_EMPTY)))

    return let(_cut(text, HEADING), build)


def split_structure(text: Column, fmt: Column) -> Column:
    """Sections by format; the whole text, untitled, where its structure gives none."""
    body = trim_ws(text)
    f = F.lower(trim_ws(fmt))
    none, whole = F.array().cast(_EMPTY), F.array(_row(F.lit(""), F.lit(0).cast("bigint"), body))
    first = lambda *ways: let(ways[0], lambda a: F.when(F.size(a) > 0, a).otherwise(first(*ways[1:]) if ways[1:] else none))
    found = (
        F.when(f.isin("pdf", "pptx"), by_pages(body)).when(f == "xlsx", by_sheets(body)).when(f.isin("markdown", "html", "docx", "text"), by_headings(body))
        .otherwise(first(by_pages(body), by_sheets(body), by_headings(body)))
    )
    # every mark of structure has a #: most texts need no pattern
    return F.when(body == "", none).when(~F.contains(body, F.lit("#")), whole).otherwise(let(found, lambda a: F.when(F.size(a) > 0, a).otherwise(whole)))


def pieces(body: Column, size: int = 800, overlap: int = 100) -> Column:
    """Stretches of at most `size` characters, each beginning `overlap` before the last one's end."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.length(body) - size) / step), F.lit(0)).cast("int"))
    return F.transform(starts, lambda i: trim_ws(F.substring(body, i * step + 1, F.lit(size))))


# fixed values: where a section that is too long is cut, the first that it has
SEPARATORS = ("\n", ".", "?", "!")


def recursive_pieces(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of about `size` characters, cut at the first separator that the text has.

    What lies between two separators is joined up to the size, the last `overlap`
    characters' worth of parts begin the next piece, and a part that is too long is
    cut at the separators that follow, or stays if there are none.
    """
    here = next((k for k, s in enumerate(separators) if s in text), len(separators) - 1)
    separator, rest = separators[here], separators[here + 1 :]
    out: list[str] = []
    held: list[str] = []

    def length() -> int:
        return sum(map(len, held)) + len(separator) * max(0, len(held) - 1)

    def close() -> None:
        if held:
            out.append(separator.join(held))

    for part in filter(None, text.split(separator)):
        if len(part) >= size:
            close()
            held.clear()
            out += recursive_pieces(part, size, overlap, rest) if rest else [part]
            continue
        if held and length() + len(separator) + len(part) > size:
            close()
            while held and (length() > overlap or length() + len(separator) + len(part) > size):
                held.pop(0)
        held.append(part)
    close()
    return [x.strip() for x in out if x.strip()]


def _recursive(size: int, overlap: int):
    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda text: [text] if len(text) <= size else recursive_pieces(text, size, overlap) or [text])

    return run


def chunk(documents: DataFrame, size: int = 800, overlap: int = 100, recursive: bool = False) -> DataFrame:
    """(chunk_id, doc_id, chunk_index, section, page, content) of documents (doc_id, format, text).

    Sections longer than `size` are cut into stretches of that length, or with
    `recursive` at separators.
    """
    if recursive:
        return _chunk_recursive(documents, size, overlap)
    marked = lambda s, p: F.when(s["page"] > 0, F.concat(F.lit("## 第 "), s["page"].cast("string"), F.lit(" 页\n\n"), p)).otherwise(p)
    parts = lambda s: F.transform(F.filter(pieces(s["content"], size, overlap), lambda p: p != ""), lambda p: F.struct(s["section"].alias("section"), s["page"].alias("page"), marked(s, p).alias("content")))
    rows = documents.select("doc_id", F.flatten(F.transform(split_structure(F.col("text"), F.col("format")), parts)).alias("chunks"))
    rows = rows.select("doc_id", F.posexplode("chunks").alias("chunk_index", "c"))
    return rows.select(
        F.concat_ws("-", "doc_id", "chunk_index").alias("chunk_id"), "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("c.section").alias("section"),
        F.nullif(F.col("c.page"), F.lit(0)).alias("page"), F.col("c.content").alias("content"),
    )


def _chunk_recursive(documents: DataFrame, size: int, overlap: int) -> DataFrame:
    sections = documents.select("doc_id", F.posexplode(split_structure(F.col("text"), F.col("format"))).alias("n", "s"))
    parts = sections.select("doc_id", "n", "s.section", "s.page", F.posexplode(_recursive(size, overlap)(F.col("s.content"))).alias("m", "piece"))
    marked = F.when((F.col("page") > 0) & ~F.col("piece").rlike(PAGE), F.concat(F.lit("## 第 "), F.col("page").cast("string"), F.lit(" 页\n\n"), "piece")).otherwise(F.col("piece"))
    rows = parts.select("doc_id", "section", "page", marked.alias("content"), F.row_number().over(Window.partitionBy("doc_id").orderBy("n", "m")).alias("k"))
    index = (F.col("k") - 1).cast("bigint")
    return rows.select(F.concat_ws("-", "doc_id", index).alias("chunk_id"), "doc_id", index.alias("chunk_index"), "section", F.nullif("page", F.lit(0)).alias("page"), "content")
