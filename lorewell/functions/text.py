"""Text functions as Column expressions: normalising, tokens, estimates, previews."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every Unicode space, as a class for both ends of a text.
_SPACES = r"[\s\x0B\p{Z}\x85]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, wherever the optimiser moves the expression."""
    return F.transform(F.array(value), body)[0]


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{_SPACES}|{_SPACES}\z", "")


def normalize_text(c: Column) -> Column:
    """Line ends become newlines, four or more of them three, and the ends are trimmed."""
    return trim_ws(F.regexp_replace(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), r"\n{4,}", "\n\n\n"))


def sanitize_text(c: Column) -> Column:
    """Without control characters other than newline, tab and return."""
    return F.regexp_replace(c, r"[\p{Cc}&&[^\n\t\r]]", "")


def tokenize(c: Column) -> Column:
    """Lower-cased letter and digit runs; a Han run gives itself and its pairs, a single one itself."""
    runs = F.regexp_extract_all(c, F.lit(r"[\p{IsHan}]+|[\p{L}\p{Nd}&&[^\p{IsHan}]]+"), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    each = lambda r: F.when(r.rlike(r"\A\p{IsHan}{2,}"), F.concat(F.array(r), pairs(r))).otherwise(F.array(F.lower(r)))
    return F.flatten(F.transform(F.coalesce(runs, F.array().cast("array<string>")), each))


def approx_tokens(c: Column) -> Column:
    """ASCII characters by four, others by one and a half, rounded apart; at least 1, and 0 for nothing."""
    other = F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))
    n = F.floor((F.length(c) - other) / 4) + F.floor((other * 2 + 2) / 3)
    return F.when(F.length(c) == 0, 0).otherwise(F.greatest(n, F.lit(1))).cast("bigint")


def preview(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def looks_binary(c: Column) -> Column:
    """Of the first 4096 bytes more than a fiftieth are NUL, or there are none."""
    head = F.encode(c, "UTF-8").substr(1, 4096)
    nul = F.length(F.regexp_replace(F.hex(head), "(..)", "$1 ")) - F.length(F.replace(F.regexp_replace(F.hex(head), "(..)", "$1 "), F.lit("00 "), F.lit("")))
    return (F.octet_length(c) == 0) | (F.floor(nul / 3) > F.floor(F.least(F.octet_length(c), F.lit(4096)) / 50))


def looks_garbled(text: Column, path: Column) -> Column:
    """Whether extracted text looks like undecoded font bytes; judged on 4000 characters."""
    seen = F.regexp_replace(F.left(text, F.lit(4000)), _SPACES, "")
    count = lambda x, keep: F.length(F.regexp_replace(x, keep, ""))

    def judge(x: Column) -> Column:
        total, han = F.length(x), count(x, r"[^\p{IsHan}]")
        lower, control, private = count(x, r"[^a-z]"), count(x, r"[^\x00-\x1F]"), count(x, r"[^\uE000-\uF8FF]")
        strange = count(x, r"[\x00-\x7F\p{IsHan}]")
        unmapped = path.rlike(r"\p{IsHan}") & (han * 50 < total) & (total > 80) & (lower * 10 < total) & (strange * 8 > total)
        return (total == 0) | (control * 20 > total) | (private * 5 > total) | unmapped

    return let(seen, judge)


def infer_page(c: Column) -> Column:
    """The first page marker's number; 0 if there is none or it is no positive number."""
    n = F.regexp_extract(c, r"##\s*第\s*([0-9]+)\s*页", 1).try_cast("bigint")
    return F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("bigint")


# fixed values: file extensions and content types by format
EXTENSIONS = {
    "pdf": ["pdf"], "docx": ["docx"], "doc": ["doc"], "xlsx": ["xlsx", "xlsm"], "pptx": ["pptx"], "html": ["html", "htm"], "markdown": ["md", "markdown"],
    "csv": ["csv"], "json": ["json"], "text": ["txt", "log", "text"], "image": ["png", "jpg", "jpeg", "webp", "tif", "tiff", "bmp", "gif"],
}
IMPORTABLE = [x for f in ("pdf", "docx", "pptx", "html", "markdown", "csv", "json", "image") for x in EXTENSIONS[f]] + ["xlsx", "txt"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)\z", 1))


def detect_format(path: Column, content_type: Column) -> Column:
    """By extension first, then by what the content type contains; '' if unknown."""
    ext, ct = extension(path), F.lower(trim_ws(content_type))
    out = None
    for name, known in EXTENSIONS.items():
        test = ext.isin(known)
        out = F.when(test, name) if out is None else out.when(test, name)
    has = ct.contains
    out = out.when(has("pdf"), "pdf").when(has("wordprocessingml") | has("msword") & has("openxml"), "docx").when(has("msword"), "doc")
    out = out.when(has("spreadsheetml") | has("excel"), "xlsx").when(has("presentationml") | has("powerpoint"), "pptx")
    for part in ("html", "markdown", "csv", "json"):
        out = out.when(has(part), part)
    return out.when(ct.startswith("text/"), "text").when(ct.startswith("image/"), "image").otherwise("")


def retryable_index_error(msg: Column) -> Column:
    low = F.lower(msg)
    return ~(msg.isNull() | low.contains("permanent") | low.contains("document gone") | low.contains("parse file:") | low.contains("split document:"))


def retryable_embed_error(msg: Column) -> Column:
    return F.coalesce(F.lower(msg).rlike("timeout|429|rate limit|too many requests|502|503|504|529|overloaded|temporarily|connection reset|eof"), F.lit(False))


def backoff_seconds(attempt: Column, base: int = 5) -> Column:
    """base * 2^(attempt - 1), the exponent within 0..5."""
    return (F.lit(base if base > 0 else 5) * F.pow(F.lit(2), F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(5)))).cast("bigint")


def link_file_name(url: Column) -> Column:
    """The decoded last part of an http(s) link's path if its extension can be imported, else null."""
    ok = url.rlike(r"(?i)\Ahttps?://[^/?#\s]+/[^\s]*\z")
    path = F.try_url_decode(F.replace(F.regexp_extract(url, r"(?i)\Ahttps?://[^/?#]+([^?#]*)", 1), F.lit("+"), F.lit("%2B")))
    base = F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*\z", 1), r"[\x00-\x1F\\]", "_")
    return F.when(ok & extension(base).isin(IMPORTABLE), base)


def fit_file_name(c: Column, size: int = 256) -> Column:
    """At most `size` characters, the extension kept."""
    ext = F.regexp_extract(c, r"(\.[^./]*)\z", 1)
    stem = F.left(c, F.length(c) - F.length(ext))
    return F.when(F.length(c) <= size, c).when(F.length(ext) >= size, F.left(c, F.lit(size))).otherwise(F.concat(F.left(stem, F.lit(size) - F.length(ext)), ext))


#: A fixed value: the stem of a note without a usable name.
DEFAULT_STEM = "youdao-note"


def sanitize_stem(c: Column) -> Column:
    """A file stem without known suffixes and reserved characters; a default name if nothing is left."""
    stem = trim_ws(c)
    for suffix in (r"\.note", r"\.lxtable", r"\.md", r"\.markdown"):
        stem = F.regexp_replace(stem, rf"{suffix}\z", "")
    clean = trim_ws(F.regexp_replace(F.regexp_replace(stem, r'[\x00-\x08\x0E-\x1F/\\:*?"<>|]|[\t\n\x0B\f\r]', "_"), _SPACES, " "))
    return F.when(clean == "", DEFAULT_STEM).otherwise(clean)


def prepare_speech(c: Column, size: int = 4000) -> Column:
    """Without citations, spaces collapsed, at most `size` characters."""
    plain = trim_ws(F.regexp_replace(F.regexp_replace(c, r"\[[0-9]+\]", ""), r"[ \t]+", " "))
    return trim_ws(F.left(plain, F.lit(size)))


def canonical_id(c: Column) -> Column:
    """A positive whole number without padding, as text; null if it is none."""
    n = trim_ws(c)
    return F.when(n.rlike(r"\A[0-9]{1,18}\z") & ~n.rlike(r"\A0+\z"), F.regexp_replace(n, r"\A0+", ""))


def canonical_ids(ids: Column, limit: int | None = None) -> Column:
    """The valid ids of a list in canonical form, each once, in their order; more than `limit` of them is an error."""
    found = F.array_distinct(F.filter(F.transform(ids, canonical_id), lambda x: x.isNotNull()))
    return found if limit is None else F.when(F.size(found) > limit, F.raise_error(F.lit(f"more than {limit} ids"))).otherwise(found)


def aligned(values: Column, n: Column, broadcast_single: bool = False, size: int | None = None) -> Column:
    """A list of n trimmed values, '' where there is none; a single one stands for all if asked for. Longer than `size` bytes is an error."""
    one = (F.size(values) == 1) if broadcast_single else F.lit(False)
    out = F.transform(F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), F.lit(1), n), lambda i: F.coalesce(trim_ws(F.get(values, F.when(one, F.lit(0)).otherwise(i))), F.lit("")))
    return out if size is None else F.when(F.exists(out, lambda x: F.octet_length(x) > size), F.raise_error(F.lit(f"a value is longer than {size} bytes"))).otherwise(out)


def leading_digits(c: Column) -> Column:
    """The number that a text begins with; 0 if it begins with none, or one that is too large."""
    return F.coalesce(F.regexp_extract(c, r"\A([0-9]+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def query_key(c: Column) -> Column:
    """What two questions have in common if they differ in case and spaces only."""
    return F.lower(F.regexp_replace(trim_ws(c), _SPACES, " "))
