"""Page layouts of PDF files that the test draws itself."""

from __future__ import annotations

import json
import time
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from folioloom import __main__ as cli
from folioloom.functions import png
from folioloom.plans import convert, documents, fixture_files
from folioloom.sources import files, pdf, precheck


def pdf_file(pages: list[bytes], packed: bool = False) -> bytes:
    """A file with one font a kind, one image and the given page contents."""
    n = len(pages)
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <76EE> endbfchar 1 beginbfrange <0002> <0003> <5F55> endbfrange"
    objects = {
        1: b"<</Type/Catalog/Pages 2 0 R>>",
        2: b"<</Type/Pages/Count %d/MediaBox[0 0 600 800]/Kids[%s]/Resources<</Font<</F1 3 0 R/F2 4 0 R>>/XObject<</I 7 0 R>>>>>>" % (n, b" ".join(b"%d 0 R" % (20 + k) for k in range(n))),
        3: b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/FirstChar 32/Widths[" + b"500 " * 95 + b"]>>",
        4: b"<</Type/Font/Subtype/Type0/BaseFont/Han/DescendantFonts[5 0 R]/ToUnicode 6 0 R>>",
        5: b"<</Type/Font/Subtype/CIDFontType2/DW 1000/W[1[900] 2 3 800]>>",
    }
    objects |= {20 + k: b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (40 + k) for k in range(n)}
    streams = {6: (b"", cmap), 7: (b"/Type/XObject/Subtype/Image/Width 1/Height 1", b"\x00")} | {40 + k: (b"", p) for k, p in enumerate(pages)}
    out = [b"%PDF-1.5\n"]
    if packed:
        at, heads, body = 0, [], []
        for k, v in objects.items():
            heads.append(b"%d %d" % (k, at))
            body.append(v + b"\n")
            at += len(v) + 1
        head = b" ".join(heads) + b"\n"
        streams[90] = (b"/Type/ObjStm/N %d/First %d" % (len(objects), len(head)), head + b"".join(body))
    else:
        out += [b"%d 0 obj\n%s\nendobj\n" % (k, v) for k, v in objects.items()]
    for k, (more, data) in streams.items():
        data = zlib.compress(data) if packed else data
        out.append(b"%d 0 obj\n<<%s/Length %d%s>>\nstream\n" % (k, more, len(data), b"/Filter/FlateDecode" if packed else b"") + data + b"\nendstream\nendobj\n")
    return b"".join(out) + b"trailer<</Root 1 0 R>>\n%%EOF"


FIRST = rb"BT /F1 10 Tf 1 0 0 1 50 700 Tm (Hello wor\154d) Tj 0 -30 Td [(A)-30(B)-900(C \(x\))] TJ /F2 20 Tf 0 -40 Td <000100020003> Tj ET q 100 0 0 50 60 400 cm /I Do Q BT /F1 10 Tf 280 20 Td (Page 1) Tj ET"
SECOND = b"q 2 0 0 2 0 0 cm BT /F1 10 Tf 14 TL 20 300 Td (one) Tj T* (two) ' ET Q"


@pytest.mark.parametrize("packed", [False, True])
def test_layout(packed):
    rows = pdf.read_layout(pdf_file([FIRST, SECOND], packed))
    assert [(r["page_index"], r["width"], r["height"]) for r in rows if r["kind"] == "page"] == [(0, 600.0, 800.0), (1, 600.0, 800.0)]
    first = [r for r in rows if r["kind"] == "char" and r["page_index"] == 0]
    assert "".join(r["text"] for r in first) == "Hello worldABC (x)目录彖Page 1"
    assert (first[0]["x0"], first[0]["x1"], first[0]["top"], first[0]["bottom"], first[0]["size"]) == pytest.approx((50, 55, 92, 102, 10))
    han = first[18:21]
    assert [r["fontname"] for r in han] == ["Han"] * 3 and [r["x1"] - r["x0"] for r in han] == pytest.approx([18, 16, 16])
    (image,) = [r for r in rows if r["kind"] == "image"]
    assert (image["x0"], image["x1"], image["top"], image["bottom"]) == pytest.approx((60, 160, 350, 400))
    second = [r for r in rows if r["kind"] == "char" and r["page_index"] == 1]
    assert second[0]["x0"] == pytest.approx(40) and second[0]["size"] == pytest.approx(20) and second[3]["top"] - second[0]["top"] == pytest.approx(56)  # two leads of 14, scaled by 2


def test_values():
    found = [v for v, _ in pdf.tokens(rb"<</A[1 -2.5 (a(b)\)\n) <4 1>]/B#20C 3 0 R>> true % note")]
    assert found == [{"A": [1, -2.5, b"a(b))\n", b"A"], "B C": 3}, True]


def test_convert(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf_file([FIRST, SECOND]))
    (tmp_path / "b.PDF").write_bytes(pdf_file([SECOND], True))
    (tmp_path / "bad.pdf").write_bytes(b"no such file")
    (tmp_path / "none.pdf").write_bytes(pdf_file([]))
    rows, status = convert.convert_pdf(spark, str(tmp_path))
    got = {}
    for r in rows.orderBy("doc_id", "line_index").collect():
        got.setdefault(r["doc_id"].rpartition("/")[2], []).append((r["page_index"], r["text"], r["is_page"]))
    assert got["a.pdf"] == [(0, "Hello world", False), (0, "AB C(x)", False), (0, "目录彖", False), (0, "{{image_1_1}}", False), (0, "Page 1", True), (1, "one", False), (1, "two", False)]
    assert got["b.PDF"] == [(0, "one", False), (0, "two", False)]
    assert {r["file_path"].rpartition("/")[2]: r["success"] for r in status.collect()} == {"a.pdf": True, "b.PDF": True, "bad.pdf": False, "none.pdf": False}
    one = convert.convert_pdf(spark, str(tmp_path), first=2)[0]
    assert {r["page_index"] for r in one.collect()} == {1}
    counts = pdf.page_counts(pdf.layout(files.files(spark, str(tmp_path))))
    assert sorted(r["n_pages"] for r in counts.collect()) == [1, 2]
    fonts = rows.where(F.col("text") == "Hello world").first()["fonts"]
    assert [(f["name"], f["size"]) for f in fonts] == [("Helvetica", 10.0)]


RULED = b"50 500 200 100 re S 150 500 m 150 600 l S 50 550 m 150 550 l S BT /F1 10 Tf 1 0 0 1 60 570 Tm (a b) Tj 0 -50 Td (c) Tj 100 30 Td (d) Tj 0 -100 Td (out) Tj ET 400 100 50 50 re f"


def test_tables():
    (table,) = [r for r in pdf.read_layout(pdf_file([RULED])) if r["kind"] == "table"]
    assert (table["x0"], table["x1"], table["top"], table["bottom"]) == pytest.approx((50, 250, 200, 300))
    assert table["cells"] == [["a b", "d"], ["c", None]]
    # Thin filled boxes are rules, and ends that miss a crossing by little still meet it.
    thin = b"".join(b"50 %d 202 0.5 re f " % y for y in (100, 150, 200)) + b"".join(b"%d 101 0.5 98 re f " % x for x in (50, 150, 250))
    (table,) = [r for r in pdf.read_layout(pdf_file([thin])) if r["kind"] == "table"]
    assert table["cells"] == [["", ""], ["", ""]]
    assert pdf.ruled_tables([(0, 0, 10, 0), (0, 0, 0, 10), (5, 0, 5, 10)]) == []


def test_filters():
    def one(data, head):
        f = pdf.File(b"%PDF-1.5\n1 0 obj\n<</Length " + str(len(data)).encode() + head + b">>\nstream\n" + data + b"\nendstream\nendobj\n")
        return f.stream(pdf.Ref(1))

    assert one(b"68 69>", b"/Filter/ASCIIHexDecode") == b"hi"
    assert one(b"BOu!r~>", b"/Filter[/ASCII85Decode]") == b"hell"
    rows = bytes([0, 1, 2, 3, 1, 5, 1, 1, 2, 1, 1, 1, 3, 2, 2, 2, 4, 1, 1, 1])
    want = bytes([1, 2, 3, 5, 6, 7, 6, 7, 8, 5, 8, 10, 6, 9, 11])
    assert one(zlib.compress(rows), b"/Filter/FlateDecode/DecodeParms<</Predictor 15/Columns 3>>") == want
    with pytest.raises(ValueError, match="unknown filter"):
        one(b"x", b"/Filter/JBIG2Decode")


def test_pictures():
    grid = bytes(range(12))
    def one(head, data):
        f = pdf.File(b"%PDF-1.5\n1 0 obj\n<</Length " + str(len(data)).encode() + head + b">>\nstream\n" + data + b"\nendstream\nendobj\n")
        return pdf.picture(f, pdf.Ref(1))

    suffix, blob = one(b"/Width 2/Height 2/BitsPerComponent 8/ColorSpace/DeviceRGB/Filter/FlateDecode", zlib.compress(grid))
    assert suffix == ".png" and png.pixels(blob).tobytes() == grid
    assert one(b"/Filter[/ASCIIHexDecode/DCTDecode]", b"ffd8>") == (".jpg", b"\xff\xd8")
    palette = one(b"/Width 2/Height 1/BitsPerComponent 4/ColorSpace[/Indexed/DeviceRGB 1 <0102030a0b0c>]", bytes([0x10]))
    assert png.pixels(palette[1]).tobytes() == bytes([10, 11, 12, 1, 2, 3])
    mask = one(b"/Width 3/Height 1/ImageMask true", bytes([0b10100000]))
    assert png.pixels(mask[1])[0, :, 0].tolist() == [255, 0, 255]
    inks = one(b"/Width 1/Height 1/ColorSpace/DeviceCMYK", bytes([255, 0, 0, 0]))
    assert png.pixels(inks[1]).tolist() == [[[0, 255, 255]]]
    with pytest.raises(ValueError, match="unknown colours"):
        one(b"/Width 1/Height 1/ColorSpace/Lab", b"123")


def test_picture_output(spark, tmp_path):
    """Images are named by their place on the page, not by the order drawn."""
    (tmp_path / "a.pdf").write_bytes(pdf_file([b"q 9 0 0 9 50 100 cm /I Do Q q 9 0 0 9 50 700 cm /I Do Q"]).replace(b"/Width 1/Height 1", b"/Width 1/Height 1/ColorSpace/DeviceGray"))
    counts = documents.convert_document(spark, f"{tmp_path}/a.pdf", f"{tmp_path}/out")
    assert counts["images"] == 2 and sorted(r["name"] for r in spark.read.parquet(f"{tmp_path}/out/images").collect()) == ["page_1_1.png", "page_1_2.png"]
    rows = pdf.pictures(files.files(spark, f"{tmp_path}/a.pdf")).collect()
    assert [(r["img_idx"], r["suffix"], r["error"]) for r in rows] == [(0, ".png", None), (1, ".png", None)]


def test_precheck(spark, tmp_path, monkeypatch):
    plain, packed = pdf_file([FIRST]), pdf_file([SECOND], True)
    for name, content in {"plain": plain, "packed": packed, "none": pdf_file([]), "bad": b"no such file"}.items():
        (tmp_path / f"{name}.pdf").write_bytes(content)
    (tmp_path / "good.pdf").write_bytes(precheck.mended(packed))
    got = {r["path"].rpartition("/")[2]: r for r in precheck.checked(files.files(spark, str(tmp_path))).collect()}
    assert {k: r["state"] for k, r in got.items()} == {"plain.pdf": "repaired", "packed.pdf": "repaired", "none.pdf": "degraded", "bad.pdf": "degraded", "good.pdf": "ok"}
    for name, content in (("plain.pdf", plain), ("packed.pdf", packed)):
        again = bytes(got[name]["content"])
        assert precheck.problem(again) is None and pdf.read_layout(again) == pdf.read_layout(content)
        # The appended table tells where each object stands.
        f = pdf.File(again)
        own = max(f.objects)
        table = f.stream(pdf.Ref(own))
        for n, (at, _) in f.places.items():
            assert table[13 * n] == 1 and int.from_bytes(table[13 * n + 1 : 13 * n + 9]) == at
    monkeypatch.setattr(pdf, "File", lambda content: time.sleep(2))
    assert "seconds" in precheck.problem(plain, 0.1)


def test_command_line(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf_file([RULED]))
    assert cli.main(["convert", str(tmp_path / "a.pdf"), str(tmp_path / "out"), "--first", "1"], spark) == 0
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out/text"), recursiveFileLookup=True).collect()] == ["{{table_1_1}}", "out"]
    assert [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out/tables"), recursiveFileLookup=True).collect()] == [{"data": [["a b", "d"], ["c", None]], "rows": 2, "cols": 2}]
    assert cli.main(["check", str(tmp_path / "a.pdf")], spark) == 1
    assert cli.main(["repair", str(tmp_path / "a.pdf"), str(tmp_path / "b.pdf")]) == 0
    assert cli.main(["check", str(tmp_path / "b.pdf")], spark) == 0
    assert cli.main(["convert", str(tmp_path / "no.pdf"), str(tmp_path / "x")], spark) == 1
    assert cli.unused("docx", 1, None) == ["--first"] and cli.unused("pdf", 1, 2) == []


def test_words_of_a_page_equal_words_of_characters(spark, tmp_path):
    """Words that the reader cuts, and those that Spark makes of its characters: blanks of all kinds, ligatures, empty texts, jumps back and down."""
    odd = "BT /F2 10 Tf 1 0 0 1 50 500 Tm <00010002> Tj <0001> Tj 0 -3 Td <0002> Tj -9 -1 Td <00030001> Tj ET BT /F1 10 Tf 1 0 0 1 50 400 Tm (\\240a b  c\\205 ) Tj 3 0 Td (x) Tj ET"
    cmap = b"1 beginbfrange <0001> <0003> [<00660066> <3000> <>] endbfrange"
    for k, pages in enumerate(([FIRST, SECOND], [odd.encode()], [b""])):
        (tmp_path / f"{k}.pdf").write_bytes(pdf_file(pages).replace(b"1 beginbfchar <0001> <76EE> endbfchar 1 beginbfrange <0002> <0003> <5F55> endbfrange", cmap if k == 1 else b"1 beginbfrange <0001> <0003> <5F55> endbfrange"))
    rows = pdf.layout(files.files(spark, str(tmp_path)), ("char", "word"))
    plain = lambda df: [tuple(r) for r in df.drop("ord").collect()]
    order = ["doc_id", "page_index", "ord"]
    got, want = plain(pdf.drawn_words(rows).orderBy(order)), plain(pdf.words(pdf.chars(rows)).orderBy(order))
    assert got == want and len(got) > 10
    assert [r["ord"] for r in pdf.drawn_words(rows).where("doc_id like '%0.pdf' and page_index = 1").orderBy("ord").collect()] == [0, 1]


def test_wide_ranges_of_codes_are_not_spread():
    """A font whose map covers all codes holds those that are met; later entries win."""
    f = pdf.File(pdf_file([FIRST]).replace(b"1 beginbfchar <0001> <76EE> endbfchar 1 beginbfrange <0002> <0003> <5F55> endbfrange", b"1 beginbfchar <0005> <0041> endbfchar 1 beginbfrange <0000> <ffff> <0000> endbfrange 1 beginbfchar <0007> <0042> endbfchar"))
    font = f.font(f.get(pdf.Ref(4)))
    assert len(font.points) == 1
    assert font.texts(font.codes(bytes([0, 5, 0, 7, 0x76, 0xEE]))) == ["\x05", "B", "目"] and len(font.points) == 3
    assert pdf.Points(lambda n: "?")[9] == "?"


def scans(df) -> int:
    """How often files are read in a query's plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("MapInArrow") + plan.count("MapInPandas")


def test_pages_alone_need_no_contents(monkeypatch):
    content = pdf_file([FIRST, SECOND])

    def stream(*_):
        raise AssertionError

    monkeypatch.setattr(pdf.File, "stream", stream)
    assert pdf.read_columns(content, ("page",)) == ([{"kind": "page", "page_index": k, "width": 600.0, "height": 800.0} for k in (0, 1)], [])


def test_pictures_with_boxes(spark, sf_dir, tmp_path):
    """Pictures come with the boxes that a layout gives them, of a file that is read once; one drawn twice is decoded once."""
    (tmp_path / "a.pdf").write_bytes(pdf_file([b"q 9 0 0 9 50 100 cm /I Do Q (no font) Tj q 20 0 0 9 50 700 cm /I Do Q", FIRST]).replace(b"/Width 1/Height 1", b"/Width 1/Height 1/ColorSpace/DeviceGray"))
    found = files.files(spark, str(tmp_path))
    at = ["page_index", "img_idx", "x0", "x1", "top", "bottom"]
    got, want = pdf.pictures(found).select(*at, "suffix", "blob").collect(), pdf.images(pdf.layout(found)).select(*at).collect()
    assert sorted(tuple(r[:6]) for r in got) == sorted(map(tuple, want)) and len(got) == 3 and {r["suffix"] for r in got} == {".png"}
    assert scans(entry.queries()["pdf_images"](spark, sf_dir)) == 2  # files drawn, and read


def test_tables_with_page_sizes(spark, sf_dir, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf_file([RULED]))
    (table,) = pdf.tables(pdf.layout(files.files(spark, str(tmp_path)), ("table",))).collect()
    assert (table["width"], table["height"], table["table_idx"]) == (600, 800, 0)
    assert scans(entry.queries()["pdf_tables"](spark, sf_dir)) == 2


def against_sql(spark, tmp_path, name: str, texts: dict[int, str | None]) -> tuple[Counter, Counter]:
    """Rows of a query and of its SQL over documents of the given texts."""
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, str(tmp_path)).select([d[0] for d in want.description])
    return Counter(map(tuple, got.collect())), Counter(want.fetchall())


#: Texts without lines, with an empty one, with a page's lines and one more.
FEW_LINES = {1: None, 2: "", 3: "\n", 4: "\n\n", 5: "a b\n" * 40, 6: "a\n" * 41, 11: None}


def test_page_counts_of_texts_without_lines(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "pdf_page_counts", FEW_LINES)
    assert got == want == Counter([(3, 1), (4, 1), (5, 1), (6, 2)])


def test_words_of_odd_texts(spark, tmp_path):
    """No words of texts without lines; blanks that are not ASCII, and the vertical tab, are parts of words; characters of two code units are one, of every plane."""
    odd = {
        21: "a\xa0b c\x0bd \u3000e\x85f\u2028g\x1ch\u200bi", 23: "x \U0001f600y \U0001d4b3\U0001d4b3z\n\U0001f600 \U00020000\U00020001 \U0010fffd", 24: "a\rb\tc\x0cd  e",
        25: "   ", 26: "e\u0301 \ufeffx \uffff \ufffd", 27: "\U0001f600" * 3000 + " end", 28: "a\x00b \ud7ff\ue000",
    }
    got, want = against_sql(spark, tmp_path, "pdf_words", FEW_LINES | odd)
    assert got == want and {r[0] for r in want} == {3, 4, 5, 6, *odd}


def test_image_boxes_of_odd_numbers(spark, tmp_path):
    """No images of texts without lines; boxes of documents whose numbers are negative, or too large for a double."""
    got, want = against_sql(spark, tmp_path, "pdf_images", FEW_LINES | {-7: "a", -50: "a\n" * 121, -12: None, 2**53 + 1: "a"})
    assert got == want and {r[0]: r[3] for r in want} == {3: 103, 4: 104, 5: 105, 6: 106, -7: 93, -50: 100, 2**53 + 1: 143}


def test_tables_of_texts_without_lines(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "pdf_tables", FEW_LINES | {-7: "a", -12: None, 31: "a\n" * 81, 32: "\U0001f600"})
    assert got == want and Counter(r[0] for r in want) == {3: 1, 4: 1, 5: 1, 6: 1, -7: 1, 31: 2, 32: 1}


def test_files_are_handed_on_by_size():
    """Small batches of files, whatever the number of their documents; none is lost at a batch's end."""
    rows = pd.DataFrame({"doc_id": range(3000), "text": "word " * 400})
    frames = list(fixture_files.batches(iter([rows, rows[:1], rows[:0]]), fixture_files.pdf_file))
    assert max(sum(map(len, f["content"])) for f in frames) < fixture_files.BATCH + 10_000 and len(frames) > 2
    assert [p for f in frames for p in f["path"]] == [*map(str, range(3000)), "0"]
    assert frames[0]["content"][1] == fixture_files.pdf_file(1, "word " * 400)
