"""Extractors: files of ten formats to text, as Arrow batches over the standard library.

A file becomes one row (path, format, text, pages, error). What needs a model or
a PDF library goes through `Recognizers`; without one the row carries a permanent
error instead, and the others go on.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions.html import extract as html_to_text
from lorewell.functions.text import detect_format
from lorewell.sources import pages as pdf_pages

SCHEMA = "path string, format string, text string, pages int, error string"
#: Unpacked bytes that one part of an office file may have.
MAX_PART = 256 << 20


class PermanentError(ValueError):
    """A retry would not help."""


@dataclass(frozen=True)
class Recognizers:
    """Model-backed readers; None where there is none."""

    image: Callable[[bytes], str] | None = None
    #: The pages of a PDF, as texts or with a signal each.
    pdf: Callable[[bytes], list] | None = None
    #: Recognises one page of a PDF, or given pages at once.
    pdf_page: Callable[[bytes, int], str] | None = None
    pdf_whole: Callable[[bytes, list[int]], str] | None = None


def decode(data: bytes) -> tuple[str, str]:
    """Text and charset: UTF-8 with or without mark, else GB18030, else bytes as they are."""
    if data.startswith(b"\xef\xbb\xbf"):
        data = data[3:]
    for charset in ("utf-8", "gb18030"):
        try:
            return data.decode(charset), charset
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1"), "raw"


def normalize(text: str) -> str:
    return re.sub(r"\n{4,}", "\n\n\n", text.replace("\r\n", "\n").replace("\r", "\n")).strip()


def looks_binary(text: str) -> bool:
    raw = text.encode("utf-8", "surrogatepass")
    n = min(len(raw), 4096)
    return not raw or raw[:n].count(0) > n // 50


def _name(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


class Parts:
    """The parts of an office file, unpacked when they are asked for and up to a size."""

    def __init__(self, data: bytes) -> None:
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise PermanentError(f"not an office file: {e}") from e
        self.sizes = {x.filename: x.file_size for x in self.zip.infolist()}

    def __contains__(self, name: str) -> bool:
        return name in self.sizes

    def __iter__(self) -> Iterator[str]:
        return iter(self.sizes)

    def __getitem__(self, name: str) -> bytes:
        if self.sizes[name] > MAX_PART:
            raise PermanentError(f"{name} unpacks to {self.sizes[name]} bytes")
        return self.zip.read(name)

    def get(self, name: str, default: bytes | None = None) -> bytes | None:
        return self[name] if name in self.sizes else default


def word_text(xml: bytes) -> str:
    """Runs joined; tabs, breaks, cells and paragraphs as their separators."""
    out: list[str] = []
    at_start, at_end = {"tab": "\t", "br": "\n", "cr": "\n"}, {"p": "\n", "tc": "\t", "tr": "\n"}
    for event, e in ElementTree.iterparse(io.BytesIO(xml), ("start", "end")):  # however deep the tree is
        kind = _name(e)
        if event == "start":
            out.append(at_start.get(kind, ""))
        else:
            out.append((e.text or "") if kind == "t" else at_end.get(kind, ""))
            e.clear()
    return "".join(out)


def drawing_text(xml: bytes) -> str:
    """One line for each paragraph of a slide."""
    lines = []
    for p in ElementTree.fromstring(xml).iter():
        if _name(p) == "p":
            lines.append("".join(t.text or "" for t in p.iter() if _name(t) == "t").strip())
    return "\n".join(x for x in lines if x)


def _docx(data: bytes, use: Recognizers) -> tuple[str, int]:
    parts = Parts(data)
    if "word/document.xml" not in parts:
        raise PermanentError("no document part")
    text = word_text(parts["word/document.xml"]).strip()
    if not text and use.image:
        text = "\n\n".join(filter(None, (use.image(parts[k]).strip() for k in sorted(parts) if k.startswith("word/media/") and is_image(k))))
    return text, 1


def _pptx(data: bytes, use: Recognizers) -> tuple[str, int]:
    parts = Parts(data)
    slides = sorted((int(m[1]), n) for n in parts if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    out = []
    for number, name in slides:
        text = drawing_text(parts[name])
        rel = parts.get(f"ppt/slides/_rels/slide{number}.xml.rels")
        if not text and rel and use.image:
            targets = [posixpath.normpath(posixpath.join("ppt/slides", e.get("Target", ""))) for e in ElementTree.fromstring(rel)]
            text = "\n".join(filter(None, (use.image(parts[x]).strip() for x in targets if x in parts and is_image(x))))
        if text:
            out.append(f"## 第 {number} 页\n\n{text}")
    return "\n\n".join(out), len(slides)


def _xlsx(data: bytes, use: Recognizers) -> tuple[str, int]:
    parts = Parts(data)
    shared = ["".join(t.text or "" for t in e.iter() if _name(t) == "t") for e in ElementTree.fromstring(parts["xl/sharedStrings.xml"])] if "xl/sharedStrings.xml" in parts else []
    book = ElementTree.fromstring(parts.get("xl/workbook.xml", b"<x/>"))
    rels = {e.get("Id"): e.get("Target", "") for e in ElementTree.fromstring(parts.get("xl/_rels/workbook.xml.rels", b"<x/>"))}
    out, sheets = [], [e for e in book.iter() if _name(e) == "sheet"]
    for sheet in sheets:
        target = rels.get(next((v for k, v in sheet.attrib.items() if k.endswith("}id")), None), "")
        xml = parts.get(target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target)))
        rows = []
        for row in (e for e in ElementTree.fromstring(xml).iter() if _name(e) == "row") if xml else ():
            cells = []
            for cell in row:
                v = next((e.text or "" for e in cell if _name(e) == "v"), "")
                inline = "".join(t.text or "" for t in cell.iter() if _name(t) == "t")
                number = int(v) if cell.get("t") == "s" and v.isdigit() else -1
                cells.append(shared[number] if 0 <= number < len(shared) else inline or v)
            if any(c.strip() for c in cells):
                rows.append("\t".join(cells).rstrip("\t"))
        if rows:
            out.append(f"## 工作表: {sheet.get('name', '')}\n" + "\n".join(rows))
    return "\n\n".join(out), len(sheets)


def _pdf(data: bytes, use: Recognizers, path: str = "") -> tuple[str, int]:
    if use.pdf is None:
        raise PermanentError("no PDF reader is set")
    found = use.pdf(pdf_pages.with_known_cmaps(data))
    by_page = (lambda k: use.pdf_page(data, k)) if use.pdf_page else None
    whole = (lambda ks: use.pdf_whole(data, ks)) if use.pdf_whole else None
    try:
        return pdf_pages.read(found, path, by_page, whole), len(found)
    except ValueError as e:
        raise PermanentError(str(e)) from e


def is_image(name: str) -> bool:
    return posixpath.splitext(name.lower())[1] in pdf_pages.IMAGES


def _image(data: bytes, use: Recognizers) -> tuple[str, int]:
    if use.image is None:
        raise PermanentError("no image recognizer is set")
    return pdf_pages.clean_recognised(use.image(data)), 1


def extract(data: bytes, fmt: str, use: Recognizers = Recognizers(), path: str = "") -> tuple[str, int]:
    """Text and number of pages, sheets or slides; PermanentError where there is no text to have."""
    readers = {"docx": _docx, "pptx": _pptx, "xlsx": _xlsx, "image": _image}
    if fmt == "pdf":
        text, pages = _pdf(data, use, path)
    elif fmt in readers:
        text, pages = readers[fmt](data, use)
    elif fmt in ("text", "markdown", "csv", "json", "html"):
        text, pages = decode(data)[0], 1
        text = html_to_text(text) or "" if fmt == "html" else text
    elif not fmt and not looks_binary(decode(data)[0]):
        text, pages = decode(data)[0], 1
    else:
        raise PermanentError(f"unsupported format: {fmt or 'unknown'}")
    text = normalize(text)
    if not text:
        raise PermanentError("no text")
    return text, pages


def read_files(spark: SparkSession, path: str, use: Recognizers = Recognizers(), content_type: Column | str = "") -> DataFrame:
    """One row (path, format, text, pages, error) for each file below a path.

    The format follows from a file's extension, else from its content type: one
    for all, or an expression over `path`. A file that cannot be read has its
    error and no text; the others go on.
    """
    kind = F.lit(content_type) if isinstance(content_type, str) else content_type
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", detect_format(F.col("path"), kind).alias("format"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, fmt, data in batch.itertuples(index=False):
                try:
                    rows.append((file, fmt, *extract(bytes(data), fmt, use, file), None))
                except Exception as e:  # whatever a broken file does to a parser, it is that file's error
                    rows.append((file, fmt, None, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "format", "text", "pages", "error"])

    return files.mapInPandas(run, SCHEMA)
