"""Files drawn from the lines of `documents`, whole texts, for queries that read files.

What a line carries goes by its number, so that SQL can tell it.
"""

from __future__ import annotations

import functools
import io
import itertools
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.functions import png

PAGE_LINES = 40
#: Fixed value: bytes of files that are handed to Spark at once, but for larger files.
BATCH = 8_000_000
NAMES = (
    'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" '
    'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
)


def lines_of(text: str | None) -> list[str]:
    parts = (text or "").split("\n")
    return parts[:-1] if parts[-1] == "" else parts


@functools.cache
def _solid(colour: tuple[int, int, int]) -> bytes:
    return png.image(np.full((30, 10, 3), colour, np.uint8))


@functools.cache
def _numbering() -> str:
    level = lambda k, form, text, start=1: f'<w:lvl w:ilvl="{k}"><w:start w:val="{start}"/><w:numFmt w:val="{form}"/><w:lvlText w:val="{text}"/></w:lvl>'
    kinds = {"3": level(0, "decimal", "%1.") + level(1, "lowerLetter", "%1.%2)"), "5": level(0, "upperRoman", "%1"), "7": level(0, "decimal", "(%1)")}
    own = "".join(f'<w:abstractNum w:abstractNumId="a{k}">{v}</w:abstractNum>' for k, v in kinds.items())
    over = {"5": '<w:lvlOverride w:ilvl="0"><w:startOverride w:val="3"/></w:lvlOverride>'}
    return f"<w:numbering {NAMES}>{own}" + "".join(f'<w:num w:numId="{k}"><w:abstractNumId w:val="a{k}"/>{over.get(k, "")}</w:num>' for k in kinds) + "</w:numbering>"


def _paragraph(text: str, number: tuple[str, int] | None = None, style: str | None = None, broken: bool = False, image: int | None = None) -> str:
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{number[1]}"/><w:numId w:val="{number[0]}"/></w:numPr>' if number else "")
    half = len(text) // 2
    run = lambda t, more="": f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t>{more}</w:r>'
    drawn = "" if image is None else f'<w:r><w:drawing><wp:inline><wp:extent cx="100" cy="{102 if image == 2 else 300}"/><a:blip r:embed="r{image}"/></wp:inline></w:drawing></w:r>'
    return f"<w:p><w:pPr>{props}</w:pPr>{run(text[:half], '<w:br w:type="page"/>' if broken else '')}{run(text[half:])}{drawn}</w:p>"


def docx_file(doc_id: int, text: str | None) -> bytes:
    """A paragraph a line: every fourth numbered, by turns on two levels; every eighth by its style; every seventh broken over pages;
    every sixth with an image that is red, plain, square or lost. A table with one numbered cell after each five. Every eleventh file is cut off."""
    body = []
    for k, line in enumerate(lines_of(text)):
        body.append(_paragraph(line, ("3", k % 8 // 4) if k % 4 == 0 else None, "S" if k % 8 == 6 else None, k % 7 == 3, (doc_id + k) % 4 if k % 6 == 2 else None))
        if k % 5 == 4:
            body.append(f"<w:tbl><w:tr><w:tc>{_paragraph(f'cell {k}', ('7', 0))}</w:tc></w:tr></w:tbl>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<w:document {NAMES}><w:body>{''.join(body)}<w:sectPr/></w:body></w:document>")
        z.writestr("word/numbering.xml", _numbering())
        z.writestr("word/styles.xml", f'<w:styles {NAMES}><w:style w:type="paragraph" w:styleId="S"><w:pPr><w:numPr><w:numId w:val="5"/></w:numPr></w:pPr></w:style></w:styles>')
        z.writestr("word/_rels/document.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Type="x/image" Target="media/{k}.png"/>' for k in range(4)) + "</Relationships>")
        for k, colour in enumerate(((200, 10, 10), (0, 0, 200), (0, 0, 200))):
            z.writestr(f"word/media/{k}.png", _solid(colour))
    return out.getvalue()[: 100 if doc_id % 11 == 0 else None]


def _line(line: str) -> str:
    """Operators that draw a line; codes have two bytes, so each plane of code points has a font of its own."""
    if line.isascii() or max(line) <= "\uffff":
        return f"<{line.encode('utf-16-be').hex()}> Tj"
    runs = ((plane, b"".join((ord(c) & 0xFFFF).to_bytes(2) for c in own)) for plane, own in itertools.groupby(line, lambda c: ord(c) >> 16))
    return " ".join(f"/F{plane or ''} 10 Tf <{codes.hex()}> Tj" for plane, codes in runs)


def _map(plane: int) -> bytes:
    """Code points of a plane's codes; above the first, a range for each leading half of a pair."""
    head = 0xD800 + (plane - 1 << 6)
    ranges = b" ".join(b"<%04x> <%04x> <%04xdc00>" % (k << 10, (k << 10) + 1023, head + k) for k in range(64)) if plane else b"<0000> <ffff> <0000>"
    return b"1 begincodespacerange <0000> <ffff> endcodespacerange %d beginbfrange %s endbfrange" % (64 if plane else 1, ranges)


def pdf_file(doc_id: int, text: str | None) -> bytes:
    """Lines on pages of forty, in fonts that tell code points; an image on every third page, a ruled table of two cells on every other. A text without lines, null or empty, has no pages. Every eleventh file is no PDF file."""
    lines, parts = lines_of(text), []
    for page in range(0, len(lines), PAGE_LINES):
        n = page // PAGE_LINES
        shown = "".join(f"BT /F 10 Tf 1 0 0 1 50 {780 - 15 * k} Tm {_line(line)} ET\n" for k, line in enumerate(lines[page : page + PAGE_LINES]))
        if n % 3 == 0:
            # The remainder has the sign of the number, as SQL has it.
            shown += f"q 30 0 0 20 {100 + (doc_id % 50 if doc_id >= 0 else -(-doc_id % 50))} 100 cm /I Do Q\n"
        if n % 2 == 0:
            cells = "".join(f"BT /F 10 Tf 1 0 0 1 {x} 65 Tm <{word.encode('utf-16-be').hex()}> Tj ET\n" for x, word in ((60, f"p{n}"), (160, "q")))
            shown += f"50 60 200 20 re S 150 60 m 150 80 l S\n{cells}"
        parts.append(shown.encode())
    planes = [] if not text or text.isascii() else sorted({ord(c) >> 16 for c in {*text}} - {0})
    # Fonts of further planes stand behind the pages.
    fonts = b"".join(b"/F%d %d 0 R" % (plane, 7 + 2 * (len(parts) + k)) for k, plane in enumerate(planes))
    stream = lambda data: b"<</Length %d>>\nstream\n%s\nendstream" % (len(data), data)
    objects = [
        b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Count %d/MediaBox[0 0 600 800]/Kids[%s]/Resources<</Font<</F 3 0 R%s>>/XObject<</I 6 0 R>>>>>>" % (len(parts), b" ".join(b"%d 0 R" % (7 + 2 * k) for k in range(len(parts))), fonts),
        b"<</Type/Font/Subtype/Type0/BaseFont/Own/DescendantFonts[4 0 R]/ToUnicode 5 0 R>>", b"<</Type/Font/Subtype/CIDFontType2/DW 500>>", stream(_map(0)),
        b"<</Type/XObject/Subtype/Image/Width 1/Height 1/ColorSpace/DeviceGray/Length 1>>\nstream\n7\nendstream",
    ]
    for k, shown in enumerate(parts):
        objects += [b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (8 + 2 * k), stream(shown)]
    for k, plane in enumerate(planes):
        objects += [b"<</Type/Font/Subtype/Type0/BaseFont/Own/DescendantFonts[4 0 R]/ToUnicode %d 0 R>>" % (8 + 2 * (len(parts) + k)), stream(_map(plane))]
    made = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, v) for k, v in enumerate(objects, 1)) + b"trailer<</Root 1 0 R>>\n%%EOF"
    return b"no such file" if doc_id % 11 == 0 else made


def batches(frames: Iterator[pd.DataFrame], make: Callable[[int, str | None], bytes]) -> Iterator[pd.DataFrame]:
    """(path, content) of the files that make draws of rows (doc_id, text), not more at once than BATCH and a file."""
    for frame in frames:
        paths, contents, size = [], [], 0
        for doc_id, text in zip(frame["doc_id"].tolist(), frame["text"]):
            paths.append(str(doc_id))
            contents.append(make(doc_id, text))
            size += len(contents[-1])
            if size >= BATCH:
                yield pd.DataFrame({"path": paths, "content": contents})
                paths, contents, size = [], [], 0
        if paths:
            yield pd.DataFrame({"path": paths, "content": contents})


def drawn(docs: DataFrame, kind: str) -> DataFrame:
    """(path, content, doc_type) as sources.files.files has them; a file's path is its document's number."""
    make = {"docx": docx_file, "pdf": pdf_file}[kind]
    # Files are dealt as a folder of them would be; the tables of small scales have one partition.
    dealt = docs.select("doc_id", "text").repartition(2 * docs.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInPandas(lambda frames: batches(frames, make), "path string, content binary").withColumn("doc_type", F.lit(kind))
