"""HTML to text, in Arrow batches over the standard library's parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: tags whose text is dropped, and tags that begin a line
SILENT = {"script", "style", "noscript"}
BLOCKS = {"br", "p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article"}


def extract(html: str | None) -> str | None:
    """Trimmed text nodes joined by spaces, a new line where a block begins; an end tag ends no line."""
    if html is None:
        return None
    lines: list[list[str]] = [[]]
    silent: list[str] = []

    class Reader(HTMLParser):
        def handle_starttag(self, tag: str, attrs: list) -> None:
            if tag in SILENT:
                silent.append(tag)
            elif tag in BLOCKS and not silent:
                lines.append([])

        def handle_startendtag(self, tag: str, attrs: list) -> None:
            if tag in BLOCKS and not silent:
                lines.append([])

        def handle_endtag(self, tag: str) -> None:
            if silent and tag == silent[-1]:
                silent.pop()

        def handle_data(self, data: str) -> None:
            if not silent and data.strip():
                lines[-1].append(data.strip())

    reader = Reader(convert_charrefs=True)
    reader.feed(html)
    reader.close()
    return "\n".join(" ".join(x) for x in lines if x)


def html_text(column: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(extract)

    return run(column)
