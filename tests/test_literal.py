"""Text, rule and citation functions on written rows: each with the results that are expected of it."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.functions import citation, rules, text
from lorewell.functions.expansion import parse_expansion
from lorewell.operators import chunking

CASES = {}


def inline(name, columns, rows, out, results, build):
    CASES[name] = (columns, rows, out, results, build)


c = F.col
inline(
    "tokenize", "id long, q string", [(1, "股票账户 开户"), (2, "Hello 世界2 x_y"), (3, "人"), (4, ""), (5, "A-1 é")], "id long, tokens string",
    [(1, "股票账户|股票|票账|账户|开户|开户"), (2, "hello|世界|世界|2|x|y"), (3, "人"), (4, ""), (5, "a|1|é")],
    lambda d: d.select("id", F.array_join(text.tokenize(c("q")), "|").alias("tokens")),
)
inline(
    "detect_format", "id long, path string, ct string",
    [(1, "a.PDF", ""), (2, "x/b.markdown", "application/pdf"), (3, "noext", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"), (4, "noext", "application/msword"), (5, "v.unknown", "text/x"), (6, "i", "image/png"), (7, "z", ""), (8, "t.xlsm", ""), (9, "s", "application/vnd.ms-excel"), (10, "p", " TEXT/HTML; charset=utf-8")],
    "id long, format string", [(1, "pdf"), (2, "markdown"), (3, "docx"), (4, "doc"), (5, "text"), (6, "image"), (7, ""), (8, "xlsx"), (9, "xlsx"), (10, "html")],
    lambda d: d.select("id", text.detect_format(c("path"), c("ct")).alias("format")),
)
inline(
    "infer_page", "id long, content string", [(1, "## 第 12 页\nx"), (2, "##第3页"), (3, "none"), (4, "## 第 0 页"), (5, "## 第 99999999999999999999 页")], "id long, page long", [(1, 12), (2, 3), (3, 0), (4, 0), (5, 0)],
    lambda d: d.select("id", text.infer_page(c("content")).alias("page")),
)
inline(
    "normalize_text", "id long, s string", [(1, "a\r\nb\rc"), (2, "x\n\n\n\n\n\ny"), (3, "\u3000 t \n"), (4, "")], "id long, s string", [(1, "a\nb\nc"), (2, "x\n\n\ny"), (3, "t"), (4, "")],
    lambda d: d.select("id", text.normalize_text(c("s")).alias("s")),
)
inline(
    "sanitize_text", "id long, s string", [(1, "a\x01b\tc\nd\x7f"), (2, "ok"), (3, "")], "id long, s string", [(1, "ab\tc\nd"), (2, "ok"), (3, "")], lambda d: d.select("id", text.sanitize_text(c("s")).alias("s")),
)
inline(
    "binary_sniff", "id long, s string", [(1, ""), (2, "plain text"), (3, "a" * 40 + "\x00"), (4, "a" * 200 + "\x00" * 3)], "id long, binary boolean", [(1, True), (2, False), (3, True), (4, False)],
    lambda d: d.select("id", text.looks_binary(c("s")).alias("binary")),
)
inline(
    "garble_score", "id long, path string, s string", [(1, "a.pdf", "normal english text"), (2, "a.pdf", ""), (3, "a.pdf", "\ue000\ue001ab" * 10), (4, "报告.pdf", "ÀÁÂÃ" * 30), (5, "报告.pdf", "readable english body " * 8), (6, "a.pdf", "a\x01b")],
    "id long, garbled boolean", [(1, False), (2, True), (3, True), (4, True), (5, False), (6, True)], lambda d: d.select("id", text.looks_garbled(c("s"), c("path")).alias("garbled")),
)
_ERRORS = [(1, "parse file: bad"), (2, "split document: x"), (3, "Timeout waiting"), (4, "HTTP 429"), (5, "unexpected EOF"), (6, "401 unauthorized"), (7, None), (8, "permanent: no text"), (9, "document gone")]
inline(
    "retryable_index_err", "id long, msg string", _ERRORS, "id long, retry boolean", [(1, False), (2, False), (3, True), (4, True), (5, True), (6, True), (7, False), (8, False), (9, False)],
    lambda d: d.select("id", text.retryable_index_error(c("msg")).alias("retry")),
)
inline(
    "retryable_embed_err", "id long, msg string", _ERRORS, "id long, retry boolean", [(1, False), (2, False), (3, True), (4, True), (5, True), (6, False), (7, False), (8, False), (9, False)],
    lambda d: d.select("id", text.retryable_embed_error(c("msg")).alias("retry")),
)
inline("retry_backoff", "attempt long", [(k,) for k in range(0, 9)], "attempt long, seconds long", [(0, 5), (1, 5), (2, 10), (3, 20), (4, 40), (5, 80), (6, 160), (7, 160), (8, 160)], lambda d: d.select("attempt", text.backoff_seconds(c("attempt")).alias("seconds")))
inline(
    "parse_links", "id long, url string",
    [(1, "https://h.example/a/b%20c.pdf?x=1"), (2, "ftp://h/a.pdf"), (3, "https://h.example/"), (4, "https://h.example/a.exe"), (5, "http://h.example/x.MD#top"), (6, "https://h.example/a b.pdf"), (7, "nonsense"), (8, "https://h.example/c+d.txt")],
    "id long, file string", [(1, "b c.pdf"), (2, None), (3, None), (4, None), (5, "x.MD"), (6, None), (7, None), (8, "c+d.txt")], lambda d: d.select("id", text.link_file_name(c("url")).alias("file")),
)


def _validated(d):
    first = F.min("n").over(Window.partitionBy(text.trim_ws(c("url"))))
    title, url = text.trim_ws(c("title")), text.trim_ws(c("url"))
    reason = (
        F.when(title == "", "no title").when(F.octet_length(title) > 256, "title too long").when(url == "", "no link").when(F.octet_length(url) > 1024, "link too long")
        .when(text.link_file_name(url).isNull(), "bad link").when(first < c("n"), F.concat(F.lit("same as "), first)).otherwise("ok")
    )
    return d.select("n", reason.alias("reason"))


inline(
    "validate_links", "n long, title string, url string",
    [(1, "a", "https://h.example/a.pdf"), (2, "  ", "https://h.example/b.pdf"), (3, "c", " https://h.example/a.pdf "), (4, "d", ""), (5, "é" * 130, "https://h.example/e.pdf"), (6, "f", "https://h.example/" + "x" * 1100 + ".pdf"), (7, "g", "h.pdf")],
    "n long, reason string", [(1, "ok"), (2, "no title"), (3, "same as 1"), (4, "no link"), (5, "title too long"), (6, "link too long"), (7, "bad link")], _validated,
)
inline("fit_filename", "id long, name string", [(1, "short.md"), (2, "x" * 300 + ".pdf"), (3, "y" * 300)], "id long, name string", [(1, "short.md"), (2, "x" * 252 + ".pdf"), (3, "y" * 256)], lambda d: d.select("id", text.fit_file_name(c("name")).alias("name")))
inline(
    "sanitize_stem", "id long, name string", [(1, " a/b:c.note "), (2, "x.md"), (3, ""), (4, "  tab\u3000two  words"), (5, ".note")], "id long, name string", [(1, "a_b_c"), (2, "x"), (3, "youdao-note"), (4, "tab two words"), (5, "youdao-note")],
    lambda d: d.select("id", text.sanitize_stem(c("name")).alias("name")),
)
inline("tts_prepare", "id long, s string", [(1, "a [1]  b\t c [22]"), (2, "x" * 4100)], "id long, s string", [(1, "a b c"), (2, "x" * 4000)], lambda d: d.select("id", text.prepare_speech(c("s")).alias("s")))
inline("truncate_preview", "id long, s string", [(1, "短" * 5), (2, "abcdef"), (3, "")], "id long, s string", [(1, "短短短短..."), (2, "abcd..."), (3, "")], lambda d: d.select("id", text.preview(c("s"), 4).alias("s")))
inline(
    "normalize_ids", "id long, raw string", [(1, " 7 "), (2, "007"), (3, "0"), (4, "x"), (5, ""), (6, "12a"), (7, "7")], "id long, doc string", [(1, "7"), (2, "7"), (3, None), (4, None), (5, None), (6, None), (7, "7")],
    lambda d: d.select("id", text.canonical_id(c("raw")).alias("doc")),
)
_ANSWERS = [(1, "see [1] and [3].", 2), (2, "none", 2), (3, "a [0]  b [99999999999999999999] c", 3), (4, "x [1]  [1]", 1), (5, "[2]", 0), (6, "句 [9] 。", 1), (7, "[[1]]", 1)]


def _checked(d):
    show = lambda x: F.array_join(F.transform(x, lambda n: n.cast("string")), ",")
    r = d.select("id", citation.check(c("answer"), c("n").cast("bigint")).alias("r"))
    return r.select("id", c("r.answer").alias("answer"), show(c("r.valid")).alias("valid"), show(c("r.removed")).alias("removed"), c("r.changed").alias("changed"))


inline(
    "citation_validate", "id long, answer string, n long", _ANSWERS, "id long, answer string, valid string, removed string, changed boolean",
    [(1, "see [1] and .", "1", "3", True), (2, "none", "", "", False), (3, "a  b c", "", "0,9223372036854775807", True), (4, "x [1] [1]", "1", "", True), (5, "", "", "2", True), (6, "句。", "", "9", True), (7, "[[1]]", "1", "", False)],
    _checked,
)
inline(
    "filter_cited_sources", "id long, sources array<string>, cited array<long>", [(1, ["a", "b", "c"], [3, 1]), (2, ["a", "b"], []), (3, ["a"], [9]), (4, [], [1])], "id long, sources string", [(1, "a,c"), (2, "a,b"), (3, "a"), (4, "")],
    lambda d: d.select("id", F.array_join(citation.cited_sources(c("sources"), c("cited")), ",").alias("sources")),
)
inline(
    "parse_expansion", "id long, raw string",
    [(1, '["a", " b ", "", "c"]'), (2, '```json\n["x","y"]\n```'), (3, "1. first\n- second\n\n• third"), (4, ""), (5, 'noise ["k"] tail'), (6, '"quoted"')],
    "id long, queries string", [(1, "a|b"), (2, "x|y"), (3, "first|second"), (4, ""), (5, "k"), (6, "quoted")], lambda d: d.select("id", F.array_join(parse_expansion(c("raw"), 2), "|").alias("queries")),
)


def _deduped(d):
    key = text.query_key(c("v"))
    rows = d.select("id", text.query_key(c("original")).alias("own"), F.posexplode("variants").alias("pos", "v")).withColumn("key", key).where("key <> '' AND key <> own")
    first = rows.groupBy("id", "key").agg(F.min_by(text.trim_ws(c("v")), "pos").alias("v"), F.min("pos").alias("pos"))
    listed = first.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]), "|").alias("kept"))
    return d.select("id").join(listed, "id", "left").fillna("")


inline(
    "expand_dedup", "id long, original string, variants array<string>", [(1, "How  to", ["how to", "HOW TO buy", "how to  BUY", " "]), (2, "x", []), (3, "a", ["b", "c", "B"])], "id long, kept string", [(1, "HOW TO buy"), (2, ""), (3, "b|c")], _deduped,
)


def _aligned(d):
    pick = lambda a, i: F.coalesce(F.get(F.transform(a, text.trim_ws), i), F.lit(""))
    rows = d.select("id", "titles", "sources", F.explode(F.sequence(F.lit(0), c("n") - 1)).alias("i"))
    return rows.select("id", c("i").cast("bigint").alias("i"), pick("titles", c("i")).alias("title"), F.when(F.size("sources") == 1, pick("sources", F.lit(0))).otherwise(pick("sources", c("i"))).alias("source"))


inline(
    "align_fields", "id long, n int, titles array<string>, sources array<string>", [(1, 2, ["a "], ["s"]), (2, 2, [], []), (3, 2, ["a", "b", "c"], ["x", "y"])], "id long, i long, title string, source string",
    [(1, 0, "a", "s"), (1, 1, "", "s"), (2, 0, "", ""), (2, 1, "", ""), (3, 0, "a", "x"), (3, 1, "b", "y")], _aligned,
)

_ROUNDS = [(1, 1, "c1", "7", 0), (1, 2, "c2", "x", 1), (1, 3, "c3", " 9 ", 2), (2, 1, "c3", " 9 ", 2), (2, 2, "c4", "5", 3), (2, 3, "c1", "7", 0)]
_ROUND_COLUMNS = "round long, rank long, chunk_id string, doc_id string, chunk_index long"


def _global_index(d):
    first = d.groupBy("chunk_id").agg(F.min(F.struct("round", "rank")).alias("seen"))
    return first.select("chunk_id", F.row_number().over(Window.orderBy("seen")).cast("bigint").alias("number"))  # the evidence of one answer


inline("agent_global_index", _ROUND_COLUMNS, _ROUNDS, "chunk_id string, number long", [("c1", 1), ("c2", 2), ("c3", 3), ("c4", 4)], _global_index)
inline(
    "agent_hits", _ROUND_COLUMNS, _ROUNDS, "round long, rank long, doc_id string, chunk_index long, cited boolean", [(1, 1, "7", 0, True), (1, 3, "9", 2, False), (2, 1, "9", 2, False), (2, 2, "5", 3, True), (2, 3, "7", 0, True)],
    lambda d: d.join(_global_index(d), "chunk_id").select("round", "rank", text.canonical_id(c("doc_id")).alias("doc_id"), "chunk_index", c("number").isin(1, 4).alias("cited")).where("doc_id IS NOT NULL"),
)
inline(
    "merge_docs", _ROUND_COLUMNS, _ROUNDS, "chunk_id string, round long, rank long", [("c1", 1, 1), ("c2", 1, 2), ("c3", 1, 3), ("c4", 2, 2)],
    lambda d: d.groupBy("chunk_id").agg(F.min(F.struct("round", "rank")).alias("f")).select("chunk_id", "f.round", "f.rank"),
)
inline(
    "source_docs", "n long, title string, content string, page long, section string", [(1, "T", "x" * 310, 4, ""), (2, "U", "short", None, "S")], "n long, title string, preview string, page long, section string",
    [(1, "T", "x" * 300 + "...", 4, ""), (2, "U", "short", 0, "S")], lambda d: d.select("n", "title", text.preview(c("content"), 300).alias("preview"), F.coalesce("page", F.lit(0).cast("bigint")).alias("page"), "section"),
)
inline(
    "golden_load", "line long, raw string", [(1, '{"id": "a", "query": "q1", "relevant_contains": ["x", "y"]}'), (2, ""), (3, "# note"), (4, '{"query": "q2", "relevant_doc_ids": ["3"]}')], "id string, query string, expected long", [("a", "q1", 2), ("case-4", "q2", 1)],
    lambda d: d.where(~text.trim_ws(c("raw")).rlike(r"\A(#.*)?\z"))
    .select("line", F.from_json("raw", "id string, query string, relevant_doc_ids array<string>, relevant_titles array<string>, relevant_contains array<string>").alias("j"))
    .select(F.coalesce("j.id", F.concat(F.lit("case-"), "line")).alias("id"), "j.query", sum((F.coalesce(F.greatest(F.size(f"j.{x}"), F.lit(0)), F.lit(0)) for x in ("relevant_doc_ids", "relevant_titles", "relevant_contains")), F.lit(0)).cast("bigint").alias("expected")),
)
inline(
    "prompt_context", "n long, title string, page long, section string, content string", [(1, "T", 2, "", "one"), (2, "U", 0, "S", "two")], "context string", [("[1] T p.2\none\n\n[2] U S\ntwo",)],
    lambda d: d.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat(F.lit("["), "n", F.lit("] "), "title", F.when(c("page") > 0, F.concat(F.lit(" p."), "page")).otherwise(""), F.when(c("section") != "", F.concat(F.lit(" "), "section")).otherwise(""), F.lit("\n"), "content").alias("b")))), lambda x: x["b"]), "\n\n").alias("context")),
)


def _limits(d):
    names = rules.LIMITS
    return d.select("id", rules.limit_update_reason(c("code"), {n: c(n) for n in names}, 50).alias("reason"), rules.vote(c("v")).alias("vote"), rules.score(c("max_turns")).alias("score"))


inline(
    "limit_update", "id long, code string, max_files int, max_file_size_mb int, max_sessions int, max_turns int, max_voice_inputs int, max_tts int, v string",
    [(1, "t", 1, 1, 1, 1, 1, 1, "up"), (2, " ", 1, 1, 1, 1, 1, 1, "DOWN "), (3, "t", 0, 0, 1, 1, 1, 1, "x"), (4, "t", 1, 60, 1, 9, 1, 1, ""), (5, "t", 1, 60, 1, 1, 1, 0, "")],
    "id long, reason string, vote string, score int", [(1, None, "up", 1), (2, "code", "down", 1), (3, "max_files", None, 1), (4, "above system limit", "", None), (5, "max_tts", "", 1)], _limits,
)
inline(
    "allowed_audio", "id long, name string, ct string", [(1, "a.MP3", ""), (2, "a.txt", "audio/x"), (3, "a.txt", "video/webm"), (4, "a.txt", ""), (5, "noext", " APPLICATION/OGG ")], "id long, ok boolean", [(1, True), (2, True), (3, True), (4, False), (5, True)],
    lambda d: d.select("id", rules.allowed_audio(c("name"), c("ct")).alias("ok")),
)
inline(
    "error_status", "id long, msg string, forbidden boolean", [(1, "x", True), (2, "文档不存在", False), (3, "文档正在索引", False), (4, "缺少 id", False), (5, "boom", False)], "id long, status int", [(1, 403), (2, 404), (3, 409), (4, 400), (5, 500)],
    lambda d: d.select("id", rules.error_status(c("msg"), c("forbidden")).alias("status")),
)
inline(
    "note_payload", "id long, raw string", [(1, '{"query": " q "}'), (2, '{"data": {"sheets": []}}'), (3, '{"type": "JSONv0"}'), (4, "junk"), (5, "")], "id long, query string, is_table boolean, first string",
    [(1, "q", False, '{"query": " q "}'), (2, "", True, '{"data": {"sheets": []}}'), (3, "", True, '{"type": "JSONv0"}'), (4, "", False, "junk"), (5, "", False, "none")],
    lambda d: d.select("id", rules.tool_query(c("raw")).alias("query"), rules.looks_like_table(c("raw")).alias("is_table"), rules.first_non_empty(c("raw"), F.lit("none")).alias("first")),
)

COLUMNS = "id long, format string, text string"
TEXTS = [
    (1, "markdown", "intro\n# One\nbody one\n## Two\n\n### Three\nbody three"), (2, "markdown", "# Only\nbody"), (3, "markdown", "plain text"), (4, "markdown", "##\nbare\n# X\ny"),
    (5, "pdf", "lost\n## 第 1 页\nfirst\n## 第 2 页\n\n## 第 3 页\nthird"), (6, "pdf", "no marker"), (7, "xlsx", "## 工作表: A\na\tb\n## 工作表: B b \nc"), (8, "", "## 第 7 页\nx"), (9, "", "# H\na\n# I\nb"),
    (10, "html", ""), (11, "text", "a\n# T\r\nb\n# U\nc"),
]
#: The sections, written out: text splitting by hand is the check of the expression.
_SPLIT = [
    (1, 0, "", 0, "intro"), (1, 1, "One", 0, "One\n\nbody one"), (1, 2, "Two", 0, "Two"), (1, 3, "Three", 0, "Three\n\nbody three"), (2, 0, "", 0, "# Only\nbody"), (3, 0, "", 0, "plain text"),
    (4, 0, "bare", 0, "bare"), (4, 1, "X", 0, "X\n\ny"), (5, 0, "第 1 页", 1, "first"), (5, 1, "第 3 页", 3, "third"), (6, 0, "", 0, "no marker"), (7, 0, "工作表: A", 0, "a\tb"), (7, 1, "工作表: B b", 0, "c"),
    (8, 0, "第 7 页", 7, "x"), (9, 0, "H", 0, "H\n\na"), (9, 1, "I", 0, "I\n\nb"), (11, 0, "", 0, "a"), (11, 1, "T", 0, "T\n\nb"), (11, 2, "U", 0, "U\n\nc"),
]


def _sections(d):
    return d.select("id", F.posexplode(chunking.split_structure(F.col("text"), F.col("format"))).alias("n", "s")).select("id", F.col("n").cast("bigint").alias("n"), "s.section", "s.page", "s.content")


for _name, _keep in (("split_headings", (1, 2, 3, 4, 11)), ("split_pages", (5, 6)), ("split_sheets", (7,)), ("split_route", tuple(range(1, 12)))):
    inline(_name, COLUMNS, [r for r in TEXTS if r[0] in _keep], "id long, n long, section string, page long, content string", [r for r in _SPLIT if r[0] in _keep], _sections)


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    columns, rows, out, results, build = CASES[name]
    names = [x.split()[0] for x in out.split(", ")]
    got = sorted((tuple(r[c] for c in names) for r in build(spark.createDataFrame(rows, columns)).collect()), key=str)
    assert got == sorted(map(tuple, results), key=str)
