"""Queries: the text functions over whole tables, each with SQL that says the result in another way."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.functions import citation, text
from lorewell.functions.html import html_text
from lorewell.operators import chunking, quality
from lorewell.plans.registry import query

_TRIM = r"regexp_replace({x}, '\A[\s\x0b\p{{Z}}\x{{85}}]+|[\s\x0b\p{{Z}}\x{{85}}]+\z', '', 'g')"
c = F.col


def trimmed(x: str) -> str:
    return _TRIM.format(x=x)


_MARK = "CASE WHEN {n} BETWEEN 1 AND 5 THEN concat('[', {n}, ']') ELSE '' END"
_CLEAN = trimmed("replace(concat(text, ' ', " + _MARK.format(n="a") + ", ' x  ', " + _MARK.format(n="b") + "), '  ', ' ')")


@query("citations_of_answers", f"SELECT conv_id, turn, {_CLEAN} AS answer, array_to_string(list_sort(list_distinct(list_filter([a, b], lambda n: n BETWEEN 1 AND 5))), ',') AS valid, array_to_string(list_sort(list_distinct(list_filter([a, b], lambda n: n NOT BETWEEN 1 AND 5))), ',') AS removed FROM (SELECT conv_id, turn, text, turn AS a, conv_id % 9 AS b FROM conversations)")
def citations_of_answers(t):
    """Every turn with two citations after it, checked against five sources."""
    answer = F.concat("text", F.lit(" ["), "turn", F.lit("] x  ["), c("conv_id") % 9, F.lit("]"))
    show = lambda x: F.array_join(F.transform(x, lambda n: n.cast("string")), ",")
    rows = t("conversations").select("conv_id", "turn", citation.check(answer, F.lit(5).cast("bigint")).alias("r"))
    return rows.select("conv_id", "turn", c("r.answer").alias("answer"), show(c("r.valid")).alias("valid"), show(c("r.removed")).alias("removed"))


@query("files_of_links", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('a b', page_id, '.pdf') WHEN 1 THEN concat('n', page_id, '.MD') WHEN 2 THEN concat('s', page_id, '.txt') END AS file FROM pages")
def files_of_links(t):
    """The file that a link below each page's address names, if it can be imported."""
    host = F.regexp_extract("url", r"^https?://[^/]+", 0)
    ends = F.when(c("page_id") % 4 == 0, F.concat(F.lit("a%20b"), "page_id", F.lit(".pdf?x=1"))).when(c("page_id") % 4 == 1, F.concat(F.lit("n"), "page_id", F.lit(".MD#top"))).when(c("page_id") % 4 == 2, F.concat(F.lit("s"), "page_id", F.lit(".txt"))).otherwise(F.concat(F.lit("x"), "page_id", F.lit(".exe")))
    return t("pages").select("page_id", text.link_file_name(F.concat(host, F.lit("/files/"), ends)).alias("file"))


@query("formats_of_sources", "SELECT id, CASE WHEN source <> '' THEN 'markdown' WHEN id % 2 = 0 THEN 'html' ELSE '' END AS format FROM (SELECT doc_id + 1 AS id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'x' END AS source FROM documents)")
def formats_of_sources(t):
    """By the source's extension, else by the content type that came with the file."""
    return t("kb_documents").select("id", text.detect_format(c("source"), F.when(c("id") % 2 == 0, "text/HTML; charset=utf-8").otherwise("application/octet-stream")).alias("format"))


@query("normalized_texts", "SELECT doc_id, md5(" + trimmed(r"regexp_replace(replace(replace(concat(chr(10), replace(text, '. ', concat('.', chr(13), chr(10))), repeat(chr(13), 5), 'end'), concat(chr(13), chr(10)), chr(10)), chr(13), chr(10)), '\n{4,}', repeat(chr(10), 3), 'g')") + ") AS digest FROM documents")
def normalized_texts(t):
    raw = F.concat(F.lit("\n"), F.replace("text", F.lit(". "), F.lit(".\r\n")), F.lit("\r\r\r\r\rend"))
    return t("documents").select("doc_id", F.md5(text.normalize_text(raw)).alias("digest"))


@query("sanitized_texts", r"SELECT doc_id, md5(concat('ab', regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{80}-\x{9f}]', '', 'g'), chr(9), 'c')) AS digest FROM documents")
def sanitized_texts(t):
    return t("documents").select("doc_id", F.md5(text.sanitize_text(F.concat(F.lit("a\x01b"), "text", F.lit("\t\x7fc")))).alias("digest"))


@query("previews", "SELECT doc_id, CASE WHEN length(text) > 300 THEN concat(left(text, 300), '...') ELSE text END AS preview FROM documents")
def previews(t):
    return t("documents").select("doc_id", text.preview(c("text"), 300).alias("preview"))


@query("spoken_answers", "SELECT conv_id, turn, " + trimmed("left(" + trimmed(r"regexp_replace(concat(text, ' x', ' y'), '[ \t]+', ' ', 'g')") + ", 200)") + " AS spoken FROM conversations")
def spoken_answers(t):
    cited = F.concat("text", F.lit("[3] x["), "turn", F.lit("]  y"))
    return t("conversations").select("conv_id", "turn", text.prepare_speech(cited, 200).alias("spoken"))


_BODY = trimmed("text")
_THREAD = "SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, count(*) OVER (PARTITION BY conv_id) AS many FROM conversations"


@query("sections_of_threads", f"SELECT conv_id, CASE WHEN many > 1 THEN n ELSE 0 END AS n, CASE WHEN many > 1 THEN concat(role, ' ', turn) ELSE '' END AS section, CASE WHEN many > 1 THEN concat(role, ' ', turn, chr(10), chr(10), {_BODY}) ELSE " + trimmed("concat('## ', role, ' ', turn, chr(10), text)") + f" END AS content FROM ({_THREAD})")
def sections_of_threads(t):
    """A thread as a Markdown text with a heading for each turn, split at its headings."""
    block = F.concat(F.lit("## "), "role", F.lit(" "), "turn", F.lit("\n"), "text")
    threads = t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "\n").alias("text"))
    rows = threads.select("conv_id", F.posexplode(chunking.split_structure(c("text"), F.lit("markdown"))).alias("n", "s"))
    return rows.select("conv_id", c("n").cast("bigint").alias("n"), "s.section", "s.content")


@query("pages_of_threads", f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, concat('第 ', turn + 1, ' 页') AS section, CAST(turn + 1 AS BIGINT) AS page, {_BODY} AS content FROM conversations WHERE {_BODY} <> ''")
def pages_of_threads(t):
    """A thread as a text with a page for each turn; a page without text is none."""
    block = F.concat(F.lit("## 第 "), c("turn") + 1, F.lit(" 页\n\n"), "text")
    threads = t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("text"))
    rows = threads.select("conv_id", F.posexplode(chunking.split_structure(F.concat(F.lit("lost\n"), "text"), F.lit("pdf"))).alias("n", "s"))
    return rows.select("conv_id", c("n").cast("bigint").alias("n"), "s.section", "s.page", "s.content")


@query("golden_lines", "SELECT CASE WHEN item_id % 3 = 0 THEN concat('case-', item_id + 1) ELSE concat('g', item_id) END AS id, text AS query, CAST(2 AS BIGINT) AS expected FROM benchmark")
def golden_lines(t):
    """Cases written as lines of JSON and loaded again; a case without an id is named after its line."""
    case = F.struct(F.when(c("item_id") % 3 != 0, F.concat(F.lit("g"), "item_id")).alias("id"), c("text").alias("query"), F.array("text").alias("relevant_contains"), F.array(c("item_id").cast("string")).alias("relevant_doc_ids"))
    lines = t("benchmark").select((c("item_id") + 1).alias("line"), F.to_json(case).alias("raw"))
    notes = lines.limit(1).select(F.lit(0).cast("bigint").alias("line"), F.lit(" # a note").alias("raw"))
    return quality.golden_cases(lines.unionByName(notes)).select("id", "query", (F.size("doc_ids") + F.size("titles") + F.size("contains")).cast("bigint").alias("expected"))


_LIST = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{Nd}}]+')"


@query("golden_criteria", f"WITH r AS (SELECT b.item_id AS case_id, d.doc_id, d.source, d.text, row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) AS rank FROM benchmark b JOIN documents d ON b.item_id = d.doc_id % 40), h AS (SELECT r.case_id, r.rank, r.doc_id = r.case_id + 40 AS a, contains(r.source, 'web') AS b, contains(r.text, trim(left(i.text, 12))) AS c FROM r JOIN benchmark i ON i.item_id = r.case_id WHERE r.rank <= 5), s AS (SELECT case_id, min(CASE WHEN a OR b OR c THEN rank END) AS first, CAST(bool_or(a) AS INT) + CAST(bool_or(b) AS INT) + CAST(bool_or(c) AS INT) AS matched FROM h GROUP BY 1) SELECT item_id AS case_id, first IS NOT NULL AS hit, coalesce(first, 0) AS first_rank, round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr, CAST(coalesce(matched, 0) AS BIGINT) AS matched, CAST(4 AS BIGINT) AS expected, round(coalesce(matched, 0) / 4.0::DOUBLE, 6) AS recall FROM benchmark LEFT JOIN s ON s.case_id = item_id")
def golden_criteria(t):
    """Cases with criteria on a document's id, its title and its content, and a blank one that nothing meets."""
    cases = t("benchmark").select(c("item_id").alias("case_id"), "text")
    docs = t("documents").select("doc_id", c("source").alias("title"), c("text").alias("content"), (c("doc_id") % 40).alias("case_id"))
    ranked = docs.join(cases.select("case_id"), "case_id").withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("doc_id"))).where("rank <= 5")
    one = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("criterion"))
    wanted = F.array(one("doc_id", (c("case_id") + 40).cast("string")), one("title", F.lit(" web ")), one("contains", F.left("text", F.lit(12))), one("contains", F.lit(" ")))
    return quality.case_scores(ranked, cases.select("case_id", F.inline(wanted)))


_HTML = r"""SELECT page_id, coalesce(list_aggregate(list_filter(list_transform(string_split(body, chr(2)), lambda line: list_aggregate(list_filter(list_transform(string_split(line, chr(1)),
 lambda node: trim(regexp_replace(replace(replace(replace(replace(replace(node, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), chr(9) || chr(10) || chr(13) || ' ')),
 lambda x: x <> ''), 'string_agg', ' ')), lambda x: x <> ''), 'string_agg', chr(10)), '') AS text FROM
 (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)[ >].*?</(script|style|noscript)>', chr(1), 'g'), '(?s)<!--.*?-->', chr(1), 'g'),
 '(?i)<(br|p|div|li|tr|h[1-6]|section|article)(\s[^>]*)?/?>', chr(2), 'g'), '(?s)<[a-zA-Z/!][^>]*>', chr(1), 'g') AS body FROM pages)"""


@query("html_extract", _HTML)
def html_extract(t):
    return t("pages").select("page_id", html_text(c("html")).alias("text"))
