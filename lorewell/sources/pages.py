"""Pages of PDF files: what each gave, which are recognised as images, and when the whole is unreadable.

The PDF reader is the caller's; it returns a page's text and a signal of why
there may be none. Recognition is the caller's too, page by page or whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, replace

TEXT, IMAGE, DEGRADED, EMPTY = "text", "image", "degraded", "empty"

# fixed values: predefined character maps that differ in name only for what a reader without them needs
CMAPS = ("UniGB", "UniCNS", "UniJIS", "UniKS")
# fixed values: content types by extension, and what files of them begin with
IMAGES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp", ".bmp": "image/bmp", ".tif": "image/tiff", ".tiff": "image/tiff"}
MAGIC = ((b"%PDF", "application/pdf"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF87a", "image/gif"), (b"GIF89a", "image/gif"), (b"BM", "image/bmp"))


@dataclass(frozen=True)
class Page:
    text: str
    signal: str = TEXT


def with_known_cmaps(data: bytes) -> bytes:
    """Names of UTF-16 character maps become those of UCS-2, of the same length so that no offset moves."""
    for name in CMAPS:
        for way in ("H", "V"):
            data = data.replace(f"{name}-UTF16-{way}".encode(), f"{name}-UCS2-{way} ".encode())
    return data


def clean(text: str) -> str:
    """Without control characters and surrogates, but for newline, tab and return."""
    return "".join(c for c in text if c in "\n\t\r" or unicodedata.category(c) not in ("Cc", "Cs"))


def clean_recognised(text: str) -> str:
    """Without the tags that a recogniser puts around references and places."""
    return re.sub(r"(?s)<\|(ref|det)\|>.*?<\|/\1\|>|<\|[^|>]+\|>", "", text).strip()


def mime(path: str, data: bytes) -> str:
    ext = re.search(r"\.[^./]*\Z", path.lower())
    known = {**IMAGES, ".pdf": "application/pdf"}.get(ext[0] if ext else "")
    if known:
        return known
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "image/webp"
    return next((kind for magic, kind in MAGIC if data.startswith(magic)), "application/octet-stream")


def garbled(text: str, path: str) -> bool:
    """Whether extracted text looks like undecoded font bytes; judged on 4000 characters."""
    seen = [c for c in text[:4000] if not c.isspace()]
    total = len(seen)
    han = sum(map(_han, seen))
    if not total or 20 * sum(c < " " for c in seen) > total or 5 * sum("\ue000" <= c <= "\uf8ff" for c in seen) > total:
        return True
    lower, strange = sum("a" <= c <= "z" for c in seen), sum(c > "\x7f" and not _han(c) for c in seen)
    return any(map(_han, path)) and 50 * han < total > 80 and 10 * lower < total < 8 * strange


def _han(c: str) -> bool:
    name = unicodedata.name(c, "") if c > "\u2e7f" else ""
    return "IDEOGRAPH" in name or "CJK RADICAL" in name or "KANGXI RADICAL" in name


def joined(pages: list[Page]) -> str:
    """A marker and the text of each page that has one."""
    return "\n\n".join(f"## 第 {k} 页\n\n{p.text.strip()}" for k, p in enumerate(pages, 1) if p.text.strip())


def read(pages: list[Page | str], path: str, by_page: Callable[[int], str] | None = None, whole: Callable[[list[int]], str] | None = None) -> str:
    """The text of a PDF's pages.

    Pages without text that are images or empty are recognised if that is set up,
    all pages if the text is garbled: one by one, or the file at once, whose
    result stands on the first such page. ValueError where there is no text.
    """
    found = [p if isinstance(p, Page) else Page(p) for p in pages]
    if not found:
        raise ValueError("the file has no page")
    found = [Page(clean(p.text).strip(), p.signal if not clean(p.text).strip() else TEXT) for p in found]
    found = [replace(p, signal=EMPTY) if not p.text and p.signal == TEXT else p for p in found]
    if by_page or whole:
        spoiled = garbled(joined(found), path) and any(p.text for p in found)
        need = [k for k, p in enumerate(found) if spoiled or not p.text and p.signal != DEGRADED]
        if need:
            if by_page:
                new = {k: clean(clean_recognised(by_page(k + 1))).strip() for k in need}
            else:
                new = {need[0]: clean(clean_recognised(whole([k + 1 for k in need]))).strip()}
            found = [replace(p, text=new.get(k, "")) if k in need else p for k, p in enumerate(found)]
    text = joined(found)
    if not text:
        scans = sum(p.signal == IMAGE for p in found)
        broken = sum(p.signal == DEGRADED for p in found)
        raise ValueError(f"no text: {len(found)} pages, {scans} scanned, {broken} damaged")
    if garbled(text, path):
        raise ValueError("the text is undecoded font bytes")
    return text
