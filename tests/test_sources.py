"""Decoders, scanning, the facade, sinks and the incremental mode, on generated files."""

import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from paperloom import sinks
from paperloom.api import Corpus
from paperloom.sources import decoders, office
from paperloom.sources.html_markdown import html_to_markdown
from paperloom.streaming import incremental


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def pdf(*pages, compress=True):
    out = b"%PDF-1.4\n"
    for k, text in enumerate(pages):
        body = f"BT /F1 12 Tf 72 700 Td ({text}) Tj ET".encode("latin-1")
        data = zlib.compress(body) if compress else body
        out += f"{k + 1} 0 obj\n<< /Length {len(data)}{' /Filter /FlateDecode' if compress else ''} >>\nstream\n".encode() + data + b"\nendstream\nendobj\n"
    return out + b"%%EOF"


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = zipped({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t xml:space="preserve"> text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>'})
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
XLSX = zipped({
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" sheetId="1" r:id="rId1"/><sheet name="Two" sheetId="2" r:id="rId2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>Name</t></si></sst>",
    "xl/styles.xml": f'<styleSheet {S}><fonts><font/><font><b/><color rgb="FFFF0000"/></font></fonts><fills><fill/></fills><cellXfs><xf fontId="0" fillId="0"/><xf fontId="1" fillId="0"/></cellXfs></styleSheet>',
    "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s" s="1"><v>0</v></c><c r="B1"><v>42</v></c></row><row r="3"><c r="B3" t="inlineStr"><is><t>longer value</t></is></c></row></sheetData></worksheet>',
    "xl/worksheets/sheet2.xml": f"<worksheet {S}><sheetData/></worksheet>",
})
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
PPTX = zipped({
    "ppt/slides/slide2.xml": f"<p:sld {P}><p:cSld><p:spTree><p:sp><p:nvSpPr><p:nvPr/></p:nvSpPr><p:txBody><a:p><a:r><a:t>second</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:sld>",
    "ppt/slides/slide1.xml": f'<p:sld {P}><p:cSld><p:spTree><p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>First</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:sld>',
})


def test_plain_formats():
    assert office.decode("text", "中文内容 αβγδ 🎉".encode()) == (None, "中文内容 αβγδ 🎉")
    assert office.decode("text", b"")[1] == ""
    assert office.decode("json", b'{"name":"Test","nested":{"key":"value"}}')[1] == '{\n  "name": "Test",\n  "nested": {\n    "key": "value"\n  }\n}'
    assert office.decode("yaml", b"b: 1\na: [x]")[1] == "a:\n- x\nb: 1\n"
    assert office.decode("csv", b"Name,Age\nAlice,30\n")[1] == "| Name | Age |\n|---|---|\n| Alice | 30 |\n"
    assert office.decode("csv", b"")[1] == "Empty CSV file"
    with pytest.raises(office.Unsupported):
        office.decode("other", b"")


def test_office_formats():
    assert office.decode("word", DOCX)[1] == "## Title\n\n**bold** text\n\n| A |  |\n|---|---|"
    text = office.decode("excel", XLSX)[1]
    assert text.startswith("## One\n\n|") and '<span style="color: #ff0000"><strong>Name</strong></span>' in text and text.endswith("## Two\n\nEmpty sheet")
    assert office.decode("ppt", PPTX)[1] == "<!-- Slide number: 1 -->\n# First\n\n<!-- Slide number: 2 -->\nsecond"
    assert office.pdf_pages(pdf("PAGE_1 (x)".replace("(", "\\(").replace(")", "\\)"), "two")) == ["PAGE_1 (x)", "two"]
    assert office.color_hex("FFFFFFFF") is None and office.color_hex("RGB(1, 2, 255)") == "#0102ff" and office.color_hex("80aabbcc") == "#aabbcc"


def test_archives():
    data = zipped({"b.txt": "text", "../evil.txt": "no", "a.json": "{bad", "c.png": "x", "d.zip": zipped({"e.csv": "x,y"}), "f.bin": "?"})
    text = office.decode("zip", data)[1]
    assert "evil" not in text and "## b.txt\n\n```txt\ntext\n```" in text and "## a.json\n\nError:" in text and "[Media file: c.png]" in text and "| x | y |" in text and "Unsupported file type" in text
    assert text.index("a.json") < text.index("b.txt")


@pytest.mark.parametrize(
    "html, want",
    [
        ("<title> T </title><body><h2>A <b>b</b></h2><p>x <a href='http://e.org/a b' title='q'>l</a> <a href='javascript:1'>j</a><a href='/'></a></p></body>", ("T", '## A **b**\n\nx [l](http://e.org/a%20b "q") j')),
        ("<ul><li>a<li>b<ol><li>c</li></ol></li></ul><script>no</script>", (None, "* a\n* b\n  1. c")),
        ("<p>a<br>b</p><img src='data:image/png;base64,AAAA' alt='i'><pre>x\n y</pre>", (None, "a\nb\n\n![i](data:image/png;base64...)\n\n```\nx\n y\n```")),
        ("<table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td></tr></table>", (None, "| a | b\\|c |\n| --- | --- |\n| 1 |  |")),
        ("<a href='http://e.org'>http://e.org</a> &copy; <i>it</i>", (None, "<http://e.org> © *it*")),
        ("<b>open <p>next", (None, "open\n\nnext")),
    ],
)
def test_html(html, want):
    assert html_to_markdown(html) == want


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("files")
    for name, data in {"a.txt": b"Hello, World!\nThis is a test.", "b.json": b"{broken", "c.pdf": pdf("PAGE_1", "PAGE_2", "Chapter 1 Start"), "d.xlsx": XLSX, "e.unknown": b"plain", "f.pdf": b"not one"}.items():
        (path / name).write_bytes(data)
    return str(path)


def test_facade(spark, folder, tmp_path):
    corpus = Corpus.read(spark, folder)
    name = {r.doc_id: r.path.rsplit("/", 1)[1] for r in corpus.files.collect()}
    assert {name[r.doc_id]: r.status for r in corpus.results().collect()} == {"a.txt": "complete", "b.json": "failed", "c.pdf": "complete", "d.xlsx": "complete", "e.unknown": "complete", "f.pdf": "failed"}
    text = {name[r.doc_id]: r.markdown for r in corpus.markdown().collect()}
    assert text["a.txt"].startswith("Hello") and text["c.pdf"] == "PAGE_1\n\n---\n\nPAGE_2\n\n---\n\nChapter 1 Start"
    assert {name[r.doc_id]: json.loads(r.json)["unlocated_block_ids"] for r in corpus.index().collect()}["a.txt"] == ["block_00000000"]
    assert [(r.phys_start, r.phys_end, r.title) for r in corpus.plan("chapters").collect() if name[r.doc_id] == "c.pdf"] == [(2, 2, "Chapter 1")]
    assert {name[r.doc_id]: r.state for r in corpus.quality().collect()}["b.json"] == "unreadable"
    sinks.write_table(corpus.blocks(), f"{tmp_path}/blocks")
    with pytest.raises(Exception, match="already exists"):
        sinks.write_table(corpus.blocks(), f"{tmp_path}/blocks")


def test_cells(spark, folder):
    cells = decoders.cells(decoders.scan(spark, folder, "*.xlsx"))
    assert [(r.rows, r.cols) for r in decoders.sheet_sizes(cells).collect()] == [(3, 2)]
    assert {(r.col, r.width) for r in decoders.column_widths(cells).collect()} == {(1, 6), (2, 14)}


def test_layout_trees(spark):
    tree = {"pdf_info": [{"page_idx": 0, "para_blocks": [{"type": "interline_equation", "bbox": [0, 0, 1, 1], "lines": [{"spans": [{"content": "x"}]}], "blocks": [{"lines": [{"spans": [{"content": "y", "html": "<t>"}]}]}]}]}, {"page_idx": 1, "preproc_blocks": [{"type": "odd", "bbox": [0, 0, 2, 2]}]}]}
    rows = decoders.layout_blocks(spark.createDataFrame([(1, json.dumps(tree))], "doc_id long, layout string")).orderBy("seq").collect()
    assert [(r.type, r.page, r.content, r.html) for r in rows] == [("display_formula", 1, "x y", "<t>"), ("odd", 2, None, None)]


def test_names_and_structural_toc(spark):
    row = spark.range(1).select(sinks.run_name(F.lit("/x/a b.pdf"), F.lit("2024-01-02 03:04:05").cast("timestamp"), F.lit(7)).alias("n")).collect()[0].n
    assert row.startswith("a_b_20240102_030405_") and len(row.rsplit("_", 1)[1]) == 12
    chunks = spark.createDataFrame([(1, 0, 0, 4, "A", 1)], "doc_id long, chunk_idx int, phys_start int, phys_end int, title string, level int")
    assert tuple(sinks.structural_toc(chunks).collect()[0]) == (1, 1, "A", 1, 1, 5)


def test_incremental(spark, folder, tmp_path):
    stream = incremental.decoded_stream(incremental.watch(spark, folder))
    q = stream.writeStream.format("memory").queryName("decoded").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("decoded").count() == 6
    requests = spark.createDataFrame([("a", 0), ("a", 10), ("b", 20)], "key string, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    requests.write.parquet(f"{tmp_path}/r")
    unique = incremental.first_in_ttl(spark.readStream.schema(requests.schema).parquet(f"{tmp_path}/r"))
    q = unique.writeStream.format("memory").queryName("unique_requests").option("checkpointLocation", f"{tmp_path}/d").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.key for r in spark.table("unique_requests").collect()) == ["a", "b"]


def test_command(spark, folder, tmp_path, capsys):
    from paperloom.__main__ import main

    assert main(["convert", folder, "--out", f"{tmp_path}/out", "--split", "2", "--end-page", "1"]) == 2
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"schema_version": "1.0", "status": "partial", "documents": {"complete": 4, "failed": 2}}
    paged = spark.read.parquet(f"{tmp_path}/out/documents").join(spark.read.parquet(f"{tmp_path}/out/pages").where("error IS NULL").select("doc_id").distinct(), "doc_id")
    assert spark.read.parquet(f"{tmp_path}/out/chunks").join(paged, "doc_id").where("last_page > 2").count() == 0
    assert spark.read.parquet(f"{tmp_path}/out/blocks").where("page > 2").count() == 0
    assert spark.read.json(f"{tmp_path}/out/markdown").count() == 4
    with pytest.raises(SystemExit):
        main(["convert", folder, "--out", "x", "--split", "0"])


def test_command_limits_everything_to_the_range(spark, tmp_path, capsys):
    from paperloom.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(pdf(*[f"page {k} of the file" for k in range(1, 6)]))
    (tmp_path / "in" / "b.txt").write_text("a text has no pages")
    for name, options, want in (("p", ["--start-page", "1", "--end-page", "2"], [2, 3]), ("l", ["--start-page", "4", "--end-page", "9", "--page-range-mode", "logical", "--strict-page-range"], [4, 5])):
        assert main(["convert", str(tmp_path / "in"), "--out", f"{tmp_path}/{name}", "--chapter-split", "1", *options]) == 0
        read = lambda x: spark.read.parquet(f"{tmp_path}/{name}/{x}")  # noqa: B023, E731
        assert sorted(r.page for r in read("blocks").where("page IS NOT NULL").collect()) == want
        texts = [r.markdown for r in spark.read.json(f"{tmp_path}/{name}/markdown").collect()]
        assert any(f"page {want[0]} of" in t for t in texts) and not any("page 1 of" in t for t in texts) and "a text has no pages" in texts
        chunks_ = sorted((r.first_page, r.last_page) for r in read("chunks").where("last_page < 100").collect())
        assert chunks_ == ([(2, 2), (3, 3)] if name == "p" else [(4, 5)])
        assert read("pages").count() == 5
    capsys.readouterr()


def test_runs_of_tags_are_read_as_the_parser_reads_them(monkeypatch):
    """Pages of plain tags in any order, within comments, scripts, attributes and cut-off references, with and without runs."""
    import random
    import re

    from paperloom.sources import html_markdown as h

    r = random.Random(5)
    tags = [f"<{c}{t}>" for t in "div p b ul li table tr td a span section em h2 br pre".split() for c in ("", "/")]
    others = ["text", " a\n b ", "&amp", "&", "x < y", "<!--", "-->", "<script>", "</script>", '<a href="', '">', "<title>T", "</title>", "<", "</", "<br/>", "<DIV>", "<![CDATA["]
    pages = ["".join("".join(r.choices(r.sample(tags, 5), k=r.randrange(60)) if r.random() < 0.6 else r.choices(others, k=r.randrange(4))) for _ in range(12)) for _ in range(300)]
    assert sum(bool(h._RUN.search(x)) for x in pages) > 100
    got = [h.html_to_markdown(x) for x in pages]
    monkeypatch.setattr(h, "_RUN", re.compile("(?!)"))
    assert got == [h.html_to_markdown(x) for x in pages]


def test_deep_pages_need_no_parser(monkeypatch):
    """4000 nested elements go by the parser in a few steps, not one by one."""
    from html.parser import HTMLParser

    steps = []
    for name in ("parse_starttag", "parse_endtag"):
        monkeypatch.setattr(HTMLParser, name, lambda self, i, f=getattr(HTMLParser, name): steps.append(i) or f(self, i))
    assert html_to_markdown("<div>" * 4000 + "x" + "</div>" * 4000) == (None, "x") and len(steps) < 10


def test_q55_titles_cut_within_a_reference(spark, tmp_path):
    import duckdb

    from paperloom import queries as catalog

    titles = ["none", "Das der&&&amp;&amp", "a &lt; b", "R&D &copy &am", "&amp;amp;"]
    spark.createDataFrame([(k, f"<html><head><title>{t}</title></head><body>x &amp</body></html>") for k, t in enumerate(titles, 3)], "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, title FROM ({catalog.ORACLES['q55_html_titles']})").fetchall())
    assert sorted((r.doc_id, r.title) for r in catalog.QUERIES["q55_html_titles"](spark, str(tmp_path)).collect()) == want


def test_deep_pages_and_far_cells():
    title, text = html_to_markdown("<html><body>" + "<div><b>" * 5000 + "deep" + "</b></div>" * 5000 + "<p>after</p></body></html>")
    assert title is None and "deep" in text and text.endswith("after")
    far = XLSX_FAR
    text = office.decode("excel", far)[1]
    assert len(text) <= 200_000 + 100 and text.startswith("## One\n\n|")
    assert [(c["row"], c["col"], c["value"]) for c in office.sheet_cells(far)] == [(1, 1, "near"), (1048576, 16384, "far")]


XLSX_FAR = zipped({
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>near</t></is></c></row><row r="1048576"><c r="XFD1048576" t="inlineStr"><is><t>far</t></is></c></row></sheetData></worksheet>',
})
