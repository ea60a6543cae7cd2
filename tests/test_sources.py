"""Extractors on files made here, parameters, sinks and models."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lorewell.functions.html import extract as html
from lorewell.operators import models, postings
from lorewell.sources import extract, notes, pages, parameters, sinks


def office(**parts):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), text)
    return buffer.getvalue()


W = 'xmlns:w="w"'
DOCX = office(**{"word/document.xml": f"<w:doc {W}><w:p><w:r><w:t>Hello</w:t><w:tab/><w:t>you</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc></w:tr></w:tbl></w:doc>"})
SLIDE = '<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:sld>'
PPTX = office(**{"ppt/slides/slide10.xml": SLIDE.format("ten"), "ppt/slides/slide2.xml": SLIDE.format("two"), "ppt/slides/slide3.xml": SLIDE.format("")})
XLSX = office(**{
    "xl/workbook.xml": '<w xmlns:r="r"><sheets><sheet name="S1" r:id="r1"/><sheet name="S2" r:id="r2"/></sheets></w>',
    "xl/_rels/workbook.xml.rels": '<x><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></x>',
    "xl/sharedStrings.xml": "<s><si><t>name</t></si></s>",
    "xl/worksheets/sheet1.xml": '<w><row><c t="s"><v>0</v></c><c><v>3</v></c></row><row><c/></row></w>', "xl/worksheets/sheet2.xml": "<w><row><c/></row></w>",
})


def test_formats():
    assert extract.extract(DOCX, "docx") == ("Hello\tyou\na", 1)
    assert extract.extract(PPTX, "pptx") == ("## 第 2 页\n\ntwo\n\n## 第 10 页\n\nten", 3)
    assert extract.extract(XLSX, "xlsx") == ("## 工作表: S1\nname\t3", 2)
    assert extract.extract("中文内容".encode("gb18030"), "text") == ("中文内容", 1)
    assert extract.decode(b"\xef\xbb\xbfx") == ("x", "utf-8")
    for data, fmt in ((b"", "text"), (b"%PDF", "pdf"), (b"\x89PNG", "image"), (b"junk", "docx"), (b"\0\0", "")):
        with pytest.raises(extract.PermanentError):
            extract.extract(data, fmt)
    assert extract.extract(b"x", "image", extract.Recognizers(image=lambda b: "seen")) == ("seen", 1)
    assert extract.extract(b"x", "pdf", extract.Recognizers(pdf=lambda b: ["a", " ", "c"])) == ("## 第 1 页\n\na\n\n## 第 3 页\n\nc", 3)


def test_html():
    assert html("<p>a <b>b</b></p><script>no</script><div>c<br>d</div>&amp;") == "a b\nc\nd &"
    assert html("<p>a</p>b<table><tr><td>x</td><td>y</td></tr></table><style>p</style>") == "a b\nx y"
    assert html("<html><head><script>bad()</script><style>.x{}</style></head><body><h1>标题</h1><p>正文内容</p></body></html>") == "标题\n正文内容"
    assert html(None) is None and html("") == ""


def test_editor_notes():
    raw = '{"5":[{"4":{"l":"h1"},"5":[{"7":[{"8":"标题"}]}],"6":"h"},{"4":{"l":"h3"},"5":[{"7":[{"8":"小节"}]}],"6":"h"},{"4":{"lt":"unordered"},"5":[{"7":[{"8":"条目一"}]}],"6":"l"},{"4":{"lt":"ordered"},"5":[{"7":[{"8":"二"}]}],"6":"l"},{"5":[{"7":[{"8":" 正文"},{"8":"一段"}]}],"6":"p"},{"4":{"fn":"说明.pdf"},"6":"a"},{"6":"h"}]}'
    assert notes.note_markdown(raw) == "# 标题\n\n### 小节\n\n- 条目一\n\n1. 二\n\n正文一段\n\n- 附件：说明.pdf"
    assert notes.note_markdown('[{"5":[{"8":"x"}]}, "y"]') == "x\n\ny"
    deep = '{"5":[{"5":' + '[{"7":' * 300 + '[{"8":"deep"}]' + "}]" * 300 + "}]}"
    assert notes.note_markdown(deep) == "deep"
    for bad in ("{", "{}", '{"5":[]}', "[" * 100_000):
        with pytest.raises(notes.NoteError):
            notes.note_markdown(bad)


def test_table_notes():
    raw = '{"type":"http://sharejs.org/types/JSONv0","data":{"tabs":["1","0","9"],"sheets":{"0":{"title":"工作表1","rows":[0,1,2],"cols":[0,1,2],"cells":{"0,0":{"0":"日期"},"0,1":{"0":"板块"},"0,2":{"0":"涨幅"},"2,0":{"0":"7号"},"2,2":{"0":-0.0217}}},"1":{"title":"B","rows":[0],"cols":[0,1],"cells":{"0,0":{"0":2.0},"0,1":{"0":true}}},"2":{"rows":[0],"cols":[0],"cells":{"0,0":{"0":"a\\tb"}}},"3":{"rows":[],"cols":[],"cells":{}}}}}'
    assert notes.is_table(raw) and not notes.is_table("[]") and not notes.is_table("{") and notes.is_table('{"type":"x/JSONv0"}')
    assert notes.table_text(raw) == "## B\n\n2\ttrue\n\n## 工作表1\n\n日期\t板块\t涨幅\n7号\t\t-0.0217\n\na b"
    for bad in ("{}", '{"data":{"sheets":{}}}', '{"data":{"sheets":{"0":{}}}}'):
        with pytest.raises(notes.NoteError):
            notes.table_text(bad)


def test_note_payloads():
    assert notes.note_xml_text("<note><para><text>a</text><x><text>b &amp;amp; c</text></x></para></note>") == "a\n\nb & c"
    assert notes.note_xml_text("<note><text>a</text><text>b&amp;</text>") == "a\n\nb&"
    assert notes.payload_text("t", 0, '{"5":[{"5":[{"8":"x"}]}]}') == "x" and notes.payload_text("t", 1, "# md") == "# md"
    assert notes.payload_text("t.lxtable", 0, '{"data":{"sheets":{"0":{"rows":[0],"cols":[0],"cells":{"0,0":{"0":"v"}}}}}}') == "v"
    assert notes.payload_text("t", 1, " ", fetched="file") == "file"
    for bad in ("<note></note>", "<note><text>请升级后用新版编辑器</text></note>"):
        with pytest.raises(notes.NoteError):
            notes.payload_text("t", 0, bad)
    assert notes.is_note_host("Share.note.youdao.com:443") and notes.is_note_host("x.note.youdao.cn") and not notes.is_note_host("note.youdao.com.example")
    assert notes.title_extension(" A.PDF ") == ".pdf" and notes.title_extension("t.lxtable") == "" and notes.is_binary_extension(".Docx") and not notes.is_binary_extension(".md")
    assert notes.disposition_name("attachment; filename=\"a b.pdf\"; x=1") == "a b.pdf" and notes.disposition_name("attachment; filename*=UTF-8''%E4%B8%AD.md; filename=x") == "中.md" and notes.disposition_name("inline") == ""


def test_pdf_pages():
    page = pages.Page
    assert pages.read(["a\x01", page("", pages.IMAGE), "c"], "f.pdf") == "## 第 1 页\n\na\n\n## 第 3 页\n\nc"
    assert pages.read(["a", page("", pages.IMAGE), page("", pages.DEGRADED)], "f", by_page=lambda k: f"<|ref|>x<|/ref|>seen {k}") == "## 第 1 页\n\na\n\n## 第 2 页\n\nseen 2"
    assert pages.read([page("", pages.IMAGE), page("", pages.EMPTY)], "f", whole=lambda ks: f"all {ks}") == "## 第 1 页\n\nall [1, 2]"
    assert pages.read(["\ue001" * 50, "ok"], "f", by_page=lambda k: f"page {k}") == "## 第 1 页\n\npage 1\n\n## 第 2 页\n\npage 2"
    for bad in ([], [""], [page("", pages.DEGRADED)], ["\ue001" * 50]):
        with pytest.raises(ValueError):
            pages.read(bad, "f.pdf")
    assert pages.garbled("Ýþ" * 60, "/中文.pdf") and not pages.garbled("Ýþ" * 60, "/plain.pdf") and not pages.garbled("正文" * 60, "/中文.pdf")
    data = b"x UniGB-UTF16-H y UniKS-UTF16-V"
    assert pages.with_known_cmaps(data) == b"x UniGB-UCS2-H  y UniKS-UCS2-V " and len(pages.with_known_cmaps(data)) == len(data)
    assert pages.mime("a.PNG", b"") == "image/png" and pages.mime("a", b"%PDF-1") == "application/pdf" and pages.mime("a", b"GIF89a") == "image/gif" and pages.mime("a", b"?") == "application/octet-stream"


def test_read_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\r\nx")
    (tmp_path / "b.docx").write_bytes(DOCX)
    (tmp_path / "c.bin").write_bytes(b"\0" * 10)
    (tmp_path / "d.xlsx").write_bytes(office(**{"xl/workbook.xml": '<w xmlns:r="r"><sheet name="S" r:id="r1"/></w>', "xl/_rels/workbook.xml.rels": '<x><R Id="r1" Target="s.xml"/></x>', "xl/s.xml": '<w><row><c t="s"><v>9</v></c></row></w>'}))
    (tmp_path / "e.docx").write_bytes(office(**{"word/document.xml": "<d>" + "<p>" * 20_000 + "<t>deep</t>" + "</p>" * 20_000 + "</d>"}))
    (tmp_path / "f.docx").write_bytes(office(**{"word/document.xml": "<d><p>"}))
    rows = {r.path.rsplit("/", 1)[1]: r for r in extract.read_files(spark, str(tmp_path)).collect()}
    assert rows["a.md"].text == "# T\nx" and rows["b.docx"].format == "docx" and rows["c.bin"].error and rows["c.bin"].text is None
    assert rows["d.xlsx"].text.endswith("9") and rows["e.docx"].text == "deep" and rows["f.docx"].error.startswith("ParseError")
    (tmp_path / "g").write_text("plain")
    kinds = F.when(F.col("path").endswith("/g"), "text/plain").otherwise("")
    assert {r.path.rsplit("/", 1)[1]: r.format for r in extract.read_files(spark, str(tmp_path), content_type=kinds).collect()}["g"] == "text"


def test_parameters():
    p = parameters.load({"top_k": 7, "chunk_size": -1, "hybrid": "false"}, {"LOREWELL_TOP_K": "9"})
    assert (p.top_k, p.chunk_size, p.hybrid) == (9, 800, False)
    assert parameters.Parameters(candidate_k=0).pool() == 20 and parameters.Parameters(candidate_k=0, top_k=1).pool() == 10


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a b"), (2, 2, "b c")], "kb_id long, doc_id long, content string")
    sinks.write_chunks(rows, f"{tmp_path}/c")
    sinks.write_chunks(rows.where("kb_id = 2").withColumn("content", F.lit("new")), f"{tmp_path}/c")
    assert {(r.kb_id, r.content) for r in spark.read.parquet(f"{tmp_path}/c").collect()} == {(1, "a b"), (2, "new")}
    asked = spark.createDataFrame([(1, "b")], "query_id long, query string")
    assert {r.doc_id for r in postings.search(sinks.write_postings(rows, f"{tmp_path}/p"), asked, 5).collect()} == {1, 2}
    assert [r.doc_id for r in sinks.without_documents(rows, spark.createDataFrame([(1,)], "doc_id long")).collect()] == [2]
    sinks.write_report(rows.groupBy().count(), f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").first()["count"] == 2


def test_models(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, content string")
    out = {r.doc_id: r.embedding for r in models.embed_chunks(rows, models.HashEmbedder(4), batch=2).collect()}
    assert out[1] == out[3] != out[2] and abs(sum(x * x for x in out[1]) - 1) < 1e-5
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError("429")
        return "ok"

    assert models.with_retries(flaky, lambda e: "429" in str(e), 2, 1.0, waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(ValueError):
        models.with_retries(lambda: (_ for _ in ()).throw(ValueError("401")), lambda e: False)
    assert models.OverlapReranker().rerank("a b", ["b a", "c"]) == [2.0, 0.0]
    assert models.TailSummarizer().summarize("s", [("user", "t")]) == "s t"
