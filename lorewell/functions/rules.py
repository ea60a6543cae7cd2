"""Small decisions of the service as Column expressions: limits, audio files, error classes, JSON sniffing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorewell.functions.text import extension, trim_ws

# fixed values: the order in which limits are checked, audio extensions, words of client errors
LIMITS = ("max_files", "max_file_size_mb", "max_sessions", "max_turns", "max_voice_inputs", "max_tts")
AUDIO = ("webm", "ogg", "oga", "mp3", "wav", "m4a", "mp4", "mpeg", "mpga", "flac", "aac")
CLIENT = ("required", "无效", "不能", "缺少", "不属于", "仍有", "请先", "过长", "至少", "请求参数", "已达到")


def limit_update_reason(code: Column, limits: dict[str, Column], size_ceiling: int = 0) -> Column:
    """Why an update of a tenant's limits is refused: the first of no code, a limit below 1, a size above the ceiling; null if none."""
    out = F.when(trim_ws(code) == "", "code")
    for name in LIMITS:
        out = out.when(limits[name] < 1, name)
    return out.when(F.lit(size_ceiling > 0) & (limits["max_file_size_mb"] > size_ceiling), "above system limit")


def allowed_audio(name: Column, content_type: Column) -> Column:
    ct = F.lower(trim_ws(content_type))
    return ct.startswith("audio/") | ct.contains("webm") | ct.contains("ogg") | extension(name).isin(*AUDIO)


def error_status(message: Column, forbidden: Column) -> Column:
    """The status class of an error message: 403, 404, 409, 400, else 500."""
    client = message.rlike("|".join(CLIENT))
    return F.when(forbidden, 403).when(message.contains("不存在"), 404).when(message.contains("正在索引"), 409).when(client, 400).otherwise(500)


def tool_query(arguments: Column) -> Column:
    """The trimmed query of a tool call's JSON arguments; '' if there is none."""
    return F.coalesce(trim_ws(F.get_json_object(arguments, "$.query")), F.lit(""))


def looks_like_table(content: Column) -> Column:
    """Whether a note's JSON holds sheets or names a table kind."""
    kind = F.lower(F.coalesce(F.get_json_object(content, "$.type"), F.lit("")))
    return F.get_json_object(content, "$.data.sheets").isNotNull() | kind.contains("jsonv0")


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(trim_ws(c), F.lit("")) for c in columns), F.lit(""))


def vote(c: Column) -> Column:
    """up, down or ''; null where it is none of them."""
    v = F.lower(trim_ws(c))
    return F.when(v.isin("up", "down", ""), v)


def score(c: Column) -> Column:
    """0 to 5; null beyond."""
    return F.when((c >= 0) & (c <= 5), c)
