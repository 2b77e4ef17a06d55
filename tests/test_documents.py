"""Text functions on their documented examples, and documents from scanned files."""

from __future__ import annotations

import asyncio
import io
import re
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioloom.functions import png
from folioloom.functions import text as T
from folioloom.operators import contents, images, layout, typed_contents
import __spark_entry__ as entry
from folioloom.plans import fixture_files
from folioloom.plans import convert, documents
from folioloom.sinks import rewrite
from folioloom.sources import docx, files
from folioloom.streaming import landing

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def column(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("f", "pairs"),
    [
        (T.halve_pairs, {"高高兴兴": "高兴", "高高兴兴，快快乐乐": "高兴，快乐", "看看": "看看", "高高兴": "高高兴"}),
        (T.collapse_fourfold, {"目目目目录录录录": "目录", "10000": "10"}),
        (T.collapse_punctuation, {"::": ":", "——": "—", "（（": "（", "$$": "$$"}),
        (T.ordinal_value, {"1.招标条件": 1, "（一）总则": 1, "第1章": 1, "第一章  招标公告": 1, "九十九、": 99, "二十": 20, "none": None}),
        (T.is_contents_item, {"第一章 标题 1": True, "1.1 标题 10": True, "标题... 5": True, "标题 123": True, "123": False, "": False}),
        (T.is_page_number, {"第1页": True, "Page 1": True, "P.1": True, "1/100": True, "- I -": True, "I / X": True, "第 1 页": True, "hello world": False, "": False}),
        (T.contents_title, {"第一章 总则……3": "第一章 总则", "Foo-bar 4": "Foo", "  Foo 12": "Foo"}),
        (T.tidy_spaces, {"a b": "a b", "你 好": "你好", " a，b ": "a，b", "a  b": "a  b"}),
        (T.file_type, {"/a/B.PDF": "pdf", "x.docx": "docx", "x.doc": "unknown"}),
        (T.number_depth, {"1.2.3 x": 3, "4 y": 1, "一、z": 1, "w": None}),
        (T.clean_font_name, {"b'Arial'": "Arial", "Arial": "Arial"}),
        (T.normalize, {"Ａ１　中 文::": "A1中文:"}),
    ],
)
def test_examples(spark, f, pairs):
    assert column(spark, f, list(pairs)) == list(pairs.values())


def test_split(spark):
    got = column(spark, T.split_paragraph, ["内容： 1.甲； 2)乙。 （三）丙", "whole", "  ", "x. 附件A"])
    assert got == [["内容：", "1.甲；", "2)乙。", "（三）丙"], ["whole"], [], ["x.", "附件A"]]


def test_number_formats(spark):
    rows = spark.createDataFrame([(4, "upperRoman", "IV"), (28, "lowerLetter", "ab"), (12, "chineseCounting", "十二"), (105, "japaneseCounting", "一百零五"), (0, "decimal", ""), (3, "other", ""), (1, "bullet", "•")], "n int, f string, want string")
    assert rows.where(T.format_number(F.col("n"), F.col("f")) != F.col("want")).count() == 0


def paragraph(text, style=None, number=None):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{number[1]}"/><w:numId w:val="{number[0]}"/></w:numPr>' if number else "")
    return f"<w:p><w:pPr>{props}</w:pPr>" + "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in ([text] if isinstance(text, str) else text)) + "</w:p>"


def document(*body):
    numbering = f'<w:numbering {W}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl><w:lvl w:ilvl="1"><w:start w:val="1"/><w:numFmt w:val="lowerLetter"/><w:lvlText w:val="%1.%2"/></w:lvl></w:abstractNum><w:num w:numId="3"><w:abstractNumId w:val="7"/></w:num></w:numbering>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{''.join(body)}<w:sectPr/></w:body></w:document>")
        z.writestr("word/numbering.xml", numbering)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    one = document(paragraph("head", number=(3, 0)), paragraph("sub", number=(3, 1)), paragraph("sub two", number=(3, 1)), paragraph("next", number=(3, 0)), paragraph("Page 3"), paragraph("a： 1.b"), "<w:tbl><w:tr><w:tc>" + paragraph("cell") + "</w:tc></w:tr></w:tbl>")
    (tmp_path / "one.docx").write_bytes(one)
    (tmp_path / "two.docx").write_bytes(document(paragraph(["Intro", "1"], "TOC1"), paragraph(["More", "4"], "TOC2"), paragraph("body")))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "x.txt").write_text("x")
    return tmp_path


def test_docx(spark, folder):
    items, status = convert.convert_docx(spark, str(folder))
    got = [(r["element_index"], r["type"], r["content"]) for r in items.where("doc_id like '%one.docx'").orderBy("element_index", "item_pos").collect()]
    assert got == [(0, "text", "1.head"), (1, "text", "1.asub"), (2, "text", "1.bsubtwo"), (3, "text", "2.next"), (4, "page_number", "Page3"), (5, "text", "a："), (5, "text", "1.b"), (6, "table", "{{table_6}}")]
    assert {r["file_path"].rpartition("/")[2]: r["success"] for r in status.collect()} == {"one.docx": True, "two.docx": True, "bad.docx": False, "x.txt": False}


def test_lists_through_cells_and_broken_parts(spark, tmp_path):
    cell = "<w:tbl><w:tr><w:tc>" + paragraph("in a cell", number=(3, 0)) + "</w:tc></w:tr></w:tbl>"
    whole = document(paragraph("head", number=(3, 0)), cell, paragraph("next", number=(3, 0)))
    (tmp_path / "cells.docx").write_bytes(whole)
    broken = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(whole)) as old, zipfile.ZipFile(broken, "w") as new:
        new.writestr("word/document.xml", old.read("word/document.xml"))
        new.writestr("word/numbering.xml", "<not closed")
    (tmp_path / "broken.docx").write_bytes(broken.getvalue())
    items, status = convert.convert_docx(spark, str(tmp_path))
    got = [r["content"] for r in items.where("doc_id like '%cells.docx'").orderBy("element_index", "item_pos").collect()]
    assert got == ["1.head", "{{table_1}}", "3.next"]
    assert {r["file_path"].rpartition("/")[2]: r["success"] for r in status.collect()} == {"cells.docx": True, "broken.docx": False}


def test_image_diagnosis(spark):
    rows = spark.createDataFrame([(0, 100, 101, bytearray(b"no image")), (1, 100, 300, bytearray(b"")), (2, 10, 0, None)], "element_index int, width long, height long, blob binary")
    got = {r["element_index"]: r.asDict() for r in images.diagnosis(rows).collect()}
    assert [(got[k]["n_bytes"], got[k]["is_square"], got[k]["is_red"], got[k]["kept"]) for k in range(3)] == [(8, True, None, False), (0, False, None, True), (None, False, None, True)]
    assert [r["element_index"] for r in images.without_stamps(rows).orderBy("element_index").collect()] == [1, 2]


def png_rows(grid, form):
    """A PNG image whose rows are all of one form."""
    step, above, rows = grid.shape[2], np.zeros(grid[0].size, int), b""
    for row in grid.reshape(len(grid), -1).astype(int):
        left, corner = (np.concatenate([np.zeros(step, int), v[:-step]]) for v in (row, above))
        near = left + above - corner
        likest = np.where((abs(near - left) <= abs(near - above)) & (abs(near - left) <= abs(near - corner)), left, np.where(abs(near - above) <= abs(near - corner), above, corner))
        rows += bytes([form]) + bytes(((row - (0, left, above, (left + above) // 2, likest)[form]) % 256).tolist())
        above = row
    whole = png.image(grid)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return whole[: whole.index(b"IDAT") - 4] + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def test_png():
    grid = np.random.default_rng(3).integers(0, 256, (7, 5, 3), dtype=np.uint8)
    for form in range(5):
        assert (png.pixels(png_rows(grid, form)) == grid).all()
    grey = grid[:, :, :1]
    assert (png.pixels(png.image(grey)) == grey).all()
    assert png.samples(bytes([0b10110000, 0b01000000]), 3, 2, 1, 1)[:, :, 0].tolist() == [[1, 0, 1], [0, 1, 0]]
    assert png.samples(bytes([0x1F, 0x20]), 3, 1, 1, 4)[0, :, 0].tolist() == [1, 15, 2]
    with pytest.raises(ValueError):
        png.pixels(b"GIF89a")


def test_stamps_in_documents(spark, tmp_path):
    """Square or red images go, whatever decoder is installed; others stay, under the names of their places."""
    inline = '<w:p><w:r><w:drawing><wp:inline><wp:extent cx="{cx}" cy="{cy}"/><a:graphic><a:blip r:embed="{rel}"/></a:graphic></wp:inline></w:drawing></w:r><w:r><w:t>{rel}</w:t></w:r></w:p>'
    body = "".join(inline.format(cx=x, cy=y, rel=r) for r, x, y in (("red", 100, 300), ("blue", 100, 300), ("square", 100, 102), ("lost", 100, 300)))
    names = 'xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rels = "".join(f'<Relationship Id="{r}" Type="x/image" Target="media/{r}.png"/>' for r in ("red", "blue", "square", "lost"))
    blue = png.image(np.full((30, 10, 3), (0, 0, 200), np.uint8))
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W} {names}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        z.writestr("word/media/red.png", png.image(np.full((30, 10, 3), (200, 10, 10), np.uint8)))
        z.writestr("word/media/blue.png", blue)
        z.writestr("word/media/square.png", blue)
    counts = documents.convert_document(spark, f"{tmp_path}/a.docx", f"{tmp_path}/out")
    got = [r["value"] for r in spark.read.text(f"{tmp_path}/out/text", recursiveFileLookup=True).collect()]
    assert got == ["red", "blue", "{{image_1_0}}", "square", "lost"] and counts == {"text": 5, "index": 5, "pages": 0, "images": 1}
    (kept,) = spark.read.parquet(f"{tmp_path}/out/images").collect()
    assert (kept["name"], bytes(kept["content"])) == ("image_1_0.png", blue)


def test_contents_entries(spark, folder):
    rows = docx.body(files.files(spark, str(folder))).where("kind = 'p'").withColumnRenamed("path", "doc_id")
    got = contents.entries(rows).orderBy("ord").collect()
    assert [(r["level"], r["text"], r["page"]) for r in got] == [(1, "Intro", "1"), (2, "More", "4")]


def test_rewrite(spark, folder, tmp_path_factory):
    """Read again, a rewritten document has the same items, without numbering; a bookmark for each element but page numbers."""
    out = tmp_path_factory.mktemp("rewritten")
    for row in convert.rewrite_docx(spark, str(folder)).collect():
        name = row["path"].rpartition("/")[2]
        assert (row["error"] is None) == (name != "bad.docx")
        if row["content"]:
            (out / name).write_bytes(row["content"])
    rows = lambda path: sorted((r["doc_id"].rpartition("/")[2], r["element_index"], r["item_pos"], r["type"], r["content"]) for r in convert.convert_docx(spark, str(path))[0].collect())
    assert rows(out) == rows(folder)
    xml = zipfile.ZipFile(out / "one.docx").read("word/document.xml").decode()
    assert "numPr" not in xml and re.findall('w:name="(index_[0-9]+)"', xml) == [f"index_{k}" for k in (0, 1, 2, 3, 5, 6)]
    assert docx.body(files.files(spark, str(out))).where("num_id is not null").count() == 0
    twice = rewrite.rewritten((out / "one.docx").read_bytes(), marked=[0])
    assert zipfile.ZipFile(io.BytesIO(twice)).read("word/document.xml").count(b"bookmarkStart") == 1
    documents.rewrite_document(spark, f"{folder}/one.docx", f"{out}/new.docx", bookmarks=False)
    assert b"bookmark" not in zipfile.ZipFile(out / "new.docx").read("word/document.xml")
    (folder / "y.pdf").write_bytes(b"")
    with pytest.raises(ValueError, match="not a word"):
        documents.rewrite_document(spark, f"{folder}/y.pdf", f"{out}/z")


def test_prefix_behind_a_break_and_formats():
    run = '<w:r><w:rPr><w:b/></w:rPr><w:t>x</w:t></w:r>'
    page = '<w:p><w:r><w:br w:type="page"/></w:r>' + run + "</w:p>"
    cells = "<w:tbl><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl>"
    made = zipfile.ZipFile(io.BytesIO(rewrite.rewritten(document(page, f"<w:p>{run}</w:p>", "<w:p/>", cells), [0, 2, 3], {0: "1. ", 1: "2. "}))).read("word/document.xml").decode()
    assert made.count("<w:rPr><w:b/></w:rPr>") == 3 and made.index("w:br") < made.index("1. ") < made.index("2. ")
    assert docx.read_body(rewrite.rewritten(document(page), None, {0: "1. "}))[0]["text"] == "1. x"
    assert re.findall('w:name="(index_[0-9]+)"', made) == ["index_0", "index_2", "index_3"]


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        (["前言", "目录", "第一章 总则..1", "第二章 办法 12", "第三章 合同（甲）33", "第一章 总则", "第四章 后文 40"], [(2, 0, None, "第一章 总则", "1"), (3, 0, None, "第二章 办法", "12"), (4, 0, None, "第三章 合同（甲）", "33")]),
        (["x", "第一章 总则..1", "十、其他材料  319"], [(1, 0, None, "第一章 总则", "1"), (2, 0, 1, "十、其他材料", "319")]),
        (["x", "本目录如下：", "y", "1. 总则5"], [(3, 0, 1, "1. 总则", "5")]),
        (["目录", "1.1 甲...3 乙...4", "1.2 丙 72.1 丁 9", "1.3 戊"], [(1, 0, 2, "1.1 甲", "3"), (1, 1, None, "乙", "4"), (2, 0, 2, "1.2 丙", "7"), (2, 1, 2, "2.1 丁", "9")]),
        (["目录", "甲 1", *[""] * 9, "乙 2", *["丙"] * 10, "丁 3"], [(1, 0, None, "甲", "1"), (11, 0, None, "乙", "2")]),
        (["目录", "甲 1", *["丙"] * 9, "see 7a", *["丙"] * 9, "丁 3"], [(1, 0, None, "甲", "1"), (21, 0, None, "丁", "3")]),
        (["目录", "甲20000", "Name 3", "Name3", "三、", "123"], [(2, 0, None, "Name", "3"), (4, 0, 1, "三、", None)]),
        (["plain"] * 200 + ["第一章 总则..1"], []),
        (["目录"] + ["甲 1"] * 700, [(k, 0, None, "甲", "1") for k in range(1, 601)]),
        ([], []),
    ],
)
def test_typed_contents(lines, want):
    assert [(at, k, *entry) for at, k, entry in typed_contents.listed(lines)] == want


def test_typed_contents_of_documents(spark):
    """Documents by themselves, null and empty texts, paragraph numbers with gaps; a document without a list gives no rows."""
    texts = [["目录"], [], None, ["第一章", " 总则..1"], ["1.1 甲...3 乙...4"]]
    rows = [("a", 3 * k, t) for k, t in enumerate(texts)] + [("b", k, ["plain words"]) for k in range(5)]
    got = typed_contents.entries(spark.createDataFrame(rows, "doc_id string, ord int, texts array<string>")).orderBy("ord", "part").collect()
    assert [tuple(r) for r in got] == [("a", 9, 0, None, "第一章 总则", "1"), ("a", 12, 0, 2, "1.1 甲", "3"), ("a", 12, 1, None, "乙", "4")]


def test_landing(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    landing.convert_arriving(landing.arriving(spark, str(folder)), lambda df: docx.items(docx.body(df)), out + "/rows", out + "/check").awaitTermination()
    assert spark.read.parquet(out + "/rows").count() > 5


def test_convert_document(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("one"))
    documents.convert_document(spark, f"{folder}/two.docx", out)
    text = spark.read.text(out + "/text", recursiveFileLookup=True)
    assert sorted(r["value"] for r in text.collect()) == ["Intro1", "More4", "body"]
    assert sorted(r["value"] for r in spark.read.text(out + "/index", recursiveFileLookup=True).collect()) == ["0", "1", "2"]
    with pytest.raises(FileNotFoundError):
        documents.convert_document(spark, f"{folder}/missing.docx", out)
    with pytest.raises(ValueError, match="unsupported"):
        documents.convert_document(spark, f"{folder}/x.txt", out)
    with pytest.raises(RuntimeError):
        documents.convert_document(spark, f"{folder}/bad.docx", out)

    async def both():
        return await asyncio.gather(*(documents.aconvert_document(spark, f"{folder}/{n}.docx", f"{out}/{n}") for n in ("two", "bad")))

    good, bad = asyncio.run(both())
    assert good["success"] and good["output"].endswith("/two") and not bad["success"] and "BadZipFile" in bad["error"]


def test_prefixes_of_files_read_once(spark, sf_dir, tmp_path):
    """The one pass over each file gives the numbers that the joins of its parts give; a query reads no file twice for them."""
    for row in fixture_files.drawn(spark.range(1, 4).selectExpr("id as doc_id", "repeat('line\\n', 60) as text"), "docx").collect():
        (tmp_path / f"{row['path']}.docx").write_bytes(row["content"])
    W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "odd.docx", "w") as z:  # a style with number 0 and one without a level, a lost list, a level that the list lacks
        props = ('<w:pStyle w:val="S"/>', '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="0"/></w:numPr>', '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="9"/></w:numPr>', '<w:pStyle w:val="S"/><w:numPr><w:numId w:val="1"/></w:numPr>', '<w:numPr><w:ilvl w:val="1"/><w:numId w:val="1"/></w:numPr>', "")
        paragraphs = "".join(f"<w:p><w:pPr>{x}</w:pPr><w:r><w:t>x</w:t></w:r></w:p>" for x in (*props, *props)) + "<w:p/>"
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{paragraphs}<w:tbl><w:tr><w:tc>{paragraphs}</w:tc></w:tr></w:tbl><w:sdt>{paragraphs}</w:sdt>{paragraphs}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="S"><w:pPr><w:numPr><w:numId w:val="1"/></w:numPr></w:pPr></w:style></w:styles>')
        z.writestr("word/numbering.xml", f'<w:numbering {W}><w:abstractNum w:abstractNumId="a"><w:lvl w:ilvl="0"><w:lvlText w:val="%1)"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="a"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="4"/></w:lvlOverride></w:num></w:numbering>')
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    found = files.files(spark, str(tmp_path))
    got, want = (sorted(map(tuple, df.collect())) for df in (convert.file_prefixes(found), convert.list_prefixes(docx.body(found), docx.parts(found))))
    assert got == want and len({r[0] for r in got}) == 4
    for name, most in (("docx_prefixes", 2), ("docx_static_numbers", 5)):
        plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInPandas") <= most


def test_fonts_where_the_first_character_of_a_height_misses_the_line(spark):
    """Two columns of one height and font: the line of the second meets later characters only, and one that lies in a gap meets none."""
    rows = spark.createDataFrame([(1, 0, 0, 0.0, 10.0, 50.0, 20.0), (1, 0, 1, 100.0, 10.0, 150.0, 20.0), (1, 0, 2, 60.0, 10.0, 90.0, 20.0)], "doc_id long, page_index int, line int, x0 double, top double, x1 double, bottom double")
    chars = [(1, 0, k, name, 9.0, x, x + 5, 11.0, 19.0) for k, (name, x) in enumerate([("A", 0.0), ("A", 100.0), ("B", 110.0), ("B", 10.0), ("A", 120.0)])]
    found = layout.line_fonts(rows, spark.createDataFrame(chars, "doc_id long, page_index int, ord int, fontname string, size double, x0 double, x1 double, top double, bottom double"))
    assert {r["line"]: [f["name"] for f in r["fonts"]] for r in found.collect()} == {0: ["A", "B"], 1: ["A", "B"]}


def test_characters_of_one_height_meet_lines_as_one_row(spark, sf_dir):
    plan = entry.queries()["layout_lines"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan or "words" not in plan  # no line waits for Python beside its page's words
    assert "collect_list(struct(x0" not in plan and plan.count("Generate") <= 2  # words neither clustered nor dealt again for fonts
