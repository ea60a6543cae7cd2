"""Shared notes as text: editor blocks, table sheets, XML notes, and which of them a payload is.

Payloads are untyped JSON trees. Walks keep their own stack, so nesting is
bounded by the payload's size and not by the interpreter's recursion.
"""

from __future__ import annotations

import html
import json
import posixpath
import re
from collections.abc import Iterator
from urllib.parse import unquote_plus
from xml.etree import ElementTree


class NoteError(ValueError):
    """A note without text; a retry would not help."""


# fixed values: keys of an editor block
META, CHILDREN, KIND, TEXT = "4", "5", "6", "8"
# fixed values: texts that stand for a note that cannot be shown
PLACEHOLDERS = ("当前笔记内容暂时无法查看", "请升级后用新版编辑器")
# fixed values: note hosts, and extensions that are fetched as files
HOSTS = ("note.youdao.com", "share.note.youdao.com", "note.youdao.cn", "share.note.youdao.cn")
BINARY = (".pdf", ".docx", ".xlsx", ".pptx", ".png", ".jpg", ".jpeg", ".webp", ".tif", ".tiff", ".bmp", ".gif")


def _loaded(raw: str) -> object:
    try:
        return json.loads(raw)
    except (ValueError, RecursionError) as e:
        raise NoteError(f"not JSON: {e}") from e


def _strings(tree: object) -> Iterator[str]:
    """Trimmed texts of all nodes in document order, a node's own before its children's."""
    todo = [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            own = node.get(TEXT)
            if isinstance(own, str) and own.strip():
                yield own.strip()
            todo += [child for key, child in reversed(node.items()) if key != TEXT]
        elif isinstance(node, list):
            todo += reversed(node)


def _line(block: object) -> str:
    if not isinstance(block, dict):
        return str(block).strip()
    meta = block.get(META) if isinstance(block.get(META), dict) else {}
    text, kind = "".join(_strings(block.get(CHILDREN))).strip(), block.get(KIND)
    if kind == "a":
        name = meta.get("fn")
        return f"- 附件：{name.strip()}" if isinstance(name, str) and name.strip() else ""
    if not text:
        return ""
    if kind == "h":
        level = re.fullmatch(r"h([1-6])", str(meta.get("l", "")).lower())
        return "#" * (int(level[1]) if level else 2) + f" {text}"
    if kind == "l":
        return ("1. " if str(meta.get("lt", "")).lower() == "ordered" else "- ") + text
    return text


def note_markdown(raw: str) -> str:
    """Editor blocks as Markdown: headings by level, list items, attachments by name, the rest as paragraphs."""
    root = _loaded(raw)
    blocks = root if isinstance(root, list) else root.get(CHILDREN) if isinstance(root, dict) else None
    lines = [x for x in map(_line, blocks if isinstance(blocks, list) else []) if x]
    if not lines:
        raise NoteError("the note is empty")
    return "\n\n".join(lines).strip()


def _cell(cell: object) -> str:
    value = cell.get("0") if isinstance(cell, dict) else None
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return str(int(value)) if value == int(value) else repr(value)
    return re.sub(r"\r\n|[\t\n]", " ", str(value).strip()).strip()


def _sheet(sheet: object) -> str:
    """A heading and tab-joined rows: blank rows gone, the others as wide as the widest without its trailing blanks."""
    if not isinstance(sheet, dict):
        return ""
    rows, columns, cells = sheet.get("rows") or [], sheet.get("cols") or [], sheet.get("cells")
    if not isinstance(cells, dict):
        return ""
    table = [[_cell(cells.get(f"{r},{c}")) for c in columns] for r in range(len(rows))]
    table = [row for row in table if any(row)]
    wide = max((k + 1 for row in table for k, x in enumerate(row) if x), default=0)
    body = "\n".join("\t".join(row[:wide]) for row in table).strip()
    title = sheet.get("title").strip() if isinstance(sheet.get("title"), str) else ""
    return f"## {title}\n\n{body}".strip() if title and body else body


def table_text(raw: str) -> str:
    """The sheets of a table note in the order of its tabs, then those that no tab names."""
    root = _loaded(raw)
    data = root.get("data") if isinstance(root, dict) else None
    sheets = data.get("sheets") if isinstance(data, dict) else None
    if not isinstance(sheets, dict) or not sheets:
        raise NoteError("the table is empty")
    tabs = [str(x).strip() for x in data.get("tabs") or []]
    order = list(dict.fromkeys([x for x in tabs if x in sheets] + sorted(sheets)))
    text = "\n\n".join(filter(None, (_sheet(sheets[x]) for x in order)))
    if not text:
        raise NoteError("the table is empty")
    return text


def is_table(raw: str) -> bool:
    try:
        root = json.loads(raw)
    except (ValueError, RecursionError):
        return False
    if not isinstance(root, dict):
        return False
    data, kind = root.get("data"), root.get("type")
    return isinstance(data, dict) and "sheets" in data or isinstance(kind, str) and "jsonv0" in kind.lower()


def note_xml_text(raw: str) -> str:
    """The text elements of a note's XML as paragraphs; found by pattern if it does not parse."""
    try:
        found = [e.text or "" for e in ElementTree.fromstring(raw).iter() if e.tag.rpartition("}")[2] == "text"]
    except ElementTree.ParseError:
        found = re.findall(r"(?s)<text[^>]*>(.*?)</text>", raw)
    text = "\n\n".join(x for x in (html.unescape(f).strip() for f in found) if x)
    if not text or any(x in text for x in PLACEHOLDERS):
        raise NoteError("the note cannot be read")
    return text


def payload_text(title: str, domain: int, content: str, fetched: str | None = None) -> str:
    """The text of a shared note by what its content is; `fetched` is the file it points to, where content is empty."""
    content = (content or "").strip()
    if not content:
        if fetched is None:
            raise NoteError("the note is empty")
        return fetched
    if content.startswith("{"):
        if domain == 3 or (title or "").strip().lower().endswith(".lxtable") or is_table(content):
            return table_text(content)
        try:
            return note_markdown(content)
        except NoteError:
            return table_text(content)
    if content.startswith(("<?xml", "<note")):
        return note_xml_text(content)
    return content


def is_note_host(host: str) -> bool:
    host = host.strip().lower().partition(":")[0]
    return host in HOSTS or host.endswith((".note.youdao.com", ".note.youdao.cn"))


def title_extension(title: str) -> str:
    """The extension that a title ends in; a table's own is none."""
    ext = posixpath.splitext((title or "").strip())[1].lower()
    return "" if ext == ".lxtable" else ext


def is_binary_extension(ext: str) -> bool:
    return ext.strip().lower() in BINARY


def disposition_name(header: str) -> str:
    """The file name that a content disposition gives, its encoded form first; '' if it gives none."""
    encoded = re.search(r"(?i)filename\*=[^']*'[^']*'([^;]*)", header or "")
    if encoded and (name := unquote_plus(encoded[1].strip().strip('"'))):
        return posixpath.basename(name.rstrip("/"))
    plain = re.search(r"(?i)filename=\s*([^;]*)", header or "")
    return posixpath.basename(plain[1].strip().strip('"').rstrip("/")) if plain else ""
