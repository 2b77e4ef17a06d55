"""Word-processing documents written anew: bookmarks by element, list numbers as plain text.

A document's changes (its bookmarked elements and its prefixes) meet its bytes
by one join; every file is then rewritten by itself, the other parts of its
archive as they were.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.dom import minidom

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.sinks import render

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
REWRITTEN = "path string, content binary, error string"


def _inside(node, name: str) -> list:
    return node.getElementsByTagNameNS(W, name)


def _children(node, name: str) -> list:
    return [c for c in node.childNodes if c.nodeType == c.ELEMENT_NODE and (c.namespaceURI, c.localName) == (W, name)]


def _made(like, tag: str, **attributes: str):
    """A new element under the prefix that the document itself uses."""
    mark = like.prefix + ":" if like.prefix else ""
    made = like.ownerDocument.createElementNS(W, mark + tag)
    for k, v in attributes.items():
        made.setAttributeNS(W, (mark or "w:") + k, v)
    return made


def _after(node, made) -> None:
    node.parentNode.insertBefore(made, node.nextSibling)


def _drop(nodes: list) -> None:
    for node in nodes:
        node.parentNode.removeChild(node)


def paragraphs(body) -> Iterator[tuple[int, object]]:
    """(ord, paragraph) counted as the reader of documents counts: tables take a number of their own."""
    at = 0
    for child in body.childNodes:
        if child.nodeType != child.ELEMENT_NODE:
            continue
        if (child.namespaceURI, child.localName) == (W, "p"):
            yield at, child
            at += 1
            continue
        at += (child.namespaceURI, child.localName) == (W, "tbl")
        for p in _inside(child, "p"):
            yield at, p
            at += 1


def _bookmark(element, name: str, number: int) -> None:
    """Around all runs of a paragraph, or the first run of a table's first cell; around what there is where runs are missing."""
    start, end = _made(element, "bookmarkStart", id=str(number), name=name), _made(element, "bookmarkEnd", id=str(number))
    if element.localName == "tbl":
        rows = _inside(element, "tr")
        cells = _inside(rows[0], "tc") if rows else []
        first = _inside(cells[0], "p") if cells else []
        runs = _inside(first[0], "r")[:1] if first else []
    else:
        runs = _children(element, "r")
    if runs:
        runs[0].parentNode.insertBefore(start, runs[0])
        _after(runs[-1], end)
        return
    props = _children(element, "pPr")
    element.insertBefore(start, props[0].nextSibling if props else element.firstChild)
    if props:
        _after(start, end)
    else:
        element.appendChild(end)


def _prefix(p, text: str) -> None:
    """A first run that reads text, in the format of the paragraph's first run, behind a page break that opens the paragraph."""
    run, words = _made(p, "r"), _made(p, "t")
    words.setAttribute("xml:space", "preserve")
    words.appendChild(p.ownerDocument.createTextNode(text))
    every = _inside(p, "r")
    formats = _children(every[0], "rPr") if every else []
    if formats:
        run.appendChild(formats[0].cloneNode(True))
    run.appendChild(words)
    own, props = _children(p, "r"), _children(p, "pPr")
    # Only a break that stands alone opens the paragraph; one behind words does not.
    if own and _children(own[0], "br") and not _children(own[0], "t"):
        _after(own[0], run)
    elif props:
        _after(props[0], run)
    else:
        p.insertBefore(run, p.firstChild)


def _unnumbered(p) -> None:
    for props in _children(p, "pPr"):
        _drop(_children(props, "numPr"))
    _drop([r for r in _inside(p, "r") if any("AUTONUM" in "".join(t.data for t in i.childNodes) for i in _children(r, "instrText"))])


def rewritten(content: bytes, marked: list[int] | None = None, prefixes: dict[int, str] | None = None) -> bytes:
    """The document with bookmarks index_<element> at the elements marked (old ones go), and with prefixes by paragraph in place of automatic numbers; None leaves either as it is."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for item in old.infolist():
            part = old.read(item)
            if item.filename == "word/document.xml":
                part = _document(part, marked, prefixes)
            elif item.filename == "word/styles.xml" and prefixes is not None:
                with minidom.parseString(part) as tree:
                    for style in _inside(tree, "style"):
                        if style.getAttributeNS(W, "type") in ("paragraph", ""):
                            for props in _children(style, "pPr"):
                                _drop(_children(props, "numPr"))
                    part = tree.toxml("UTF-8")
            new.writestr(item, part)
    return out.getvalue()


def _document(part: bytes, marked: list[int] | None, prefixes: dict[int, str] | None) -> bytes:
    with minidom.parseString(part) as tree:
        body = _inside(tree, "body")[0]
        if prefixes is not None:
            for at, p in list(paragraphs(body)):
                _unnumbered(p)
                if at in prefixes:
                    _prefix(p, prefixes[at])
        if marked is not None:
            _drop([*_inside(body, "bookmarkStart"), *_inside(body, "bookmarkEnd")])
            elements = [c for c in body.childNodes if c.nodeType == c.ELEMENT_NODE]
            for number, k in enumerate(sorted(marked), 1):
                _bookmark(elements[k], f"index_{k}", number)
        return tree.toxml("UTF-8")


def _rewrite(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, content, marked, ords, texts in zip(frame["path"], frame["content"], frame["marked"], frame["ords"], frame["texts"]):
            try:
                made, error = rewritten(bytes(content), None if marked is None else [int(k) for k in marked], None if ords is None else dict(zip((int(k) for k in ords), texts))), None
            except Exception as e:  # noqa: BLE001  any broken file
                made, error = None, f"{type(e).__name__}: {e}"
            yield pd.DataFrame({"path": [path], "content": [made], "error": [error]}).astype(object)


def rewrite(found: DataFrame, items: DataFrame | None = None, prefixes: DataFrame | None = None) -> DataFrame:
    """(path, content, error) of the documents among found (path, content, doc_type), rewritten.

    items (doc_id, element_index, type): elements that yield any but a page
    number get a bookmark. prefixes (doc_id, ord, prefix): automatic numbers
    become this text. What is not given is left alone.
    """
    rows = found.where("doc_type = 'docx'").select("path", "content")
    none = lambda kind: F.lit(None).cast(kind)
    if items is None:
        rows = rows.withColumn("marked", none("array<int>"))
    else:
        own = render.bookmarks(items.where("type <> 'page_number'"))
        own = own.groupBy(F.col("doc_id").alias("path")).agg(F.sort_array(F.collect_list(F.substring_index("name", "_", -1).cast("int"))).alias("marked"))
        rows = rows.join(own, "path", "left").withColumn("marked", F.coalesce("marked", F.array().cast("array<int>")))
    if prefixes is None:
        rows = rows.withColumn("ords", none("array<long>")).withColumn("texts", none("array<string>"))
    else:
        own = prefixes.groupBy(F.col("doc_id").alias("path")).agg(F.collect_list(F.struct(F.col("ord").cast("long").alias("ord"), "prefix")).alias("x"))
        rows = rows.join(own, "path", "left")
        rows = rows.select("path", "content", "marked", F.coalesce("x.ord", F.array().cast("array<long>")).alias("ords"), F.coalesce("x.prefix", F.array().cast("array<string>")).alias("texts"))
    return rows.select("path", "content", "marked", "ords", "texts").mapInPandas(_rewrite, REWRITTEN)
