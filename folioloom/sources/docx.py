"""Word-processing documents (zip and XML) as tables, by the standard library.

One pass over each file gives its body items as rows of one schema; what
cannot be read gives one row with an error, so one bad file fails no job.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.functions import text as T

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
PARAGRAPHS = (
    "path string, element_index int, ord int, kind string, in_body boolean, text string, texts array<string>, style string, num_id string, ilvl string, field_begin boolean, field_end boolean, "
    "instruction string, has_image boolean, images array<struct<rel_id:string,cx:long,cy:long>>, error string"
)
ATTRIBUTES = ("start", "num_fmt", "lvl_text", "lvl_jc")
NUMBERED = "path string, ord int, use_num string, use_lvl string, start string, num_fmt string, lvl_text string, lvl_jc string, forms map<int,string>"
PARTS = "path string, part string, a string, b string, c string, start string, num_fmt string, lvl_text string, lvl_jc string, blob binary"


def _value(parent, tag: str):
    found = parent.find(f".//{W}{tag}") if parent is not None else None
    return None if found is None else found.get(f"{W}val")


def _run_text(p) -> str:
    """Texts of all runs; a run whose first break is a page break ends in a newline; other breaks and tabs go."""
    out = []
    for run in p.iter(f"{W}r"):
        out += [t.text or "" for t in run.findall(f"{W}t")]
        first = run.find(f".//{W}br")
        if first is not None and first.get(f"{W}type") == "page":
            out.append("\n")
    return "".join(out).strip()


def _paragraph(p) -> dict:
    props = p.find(f"{W}pPr")
    number = props.find(f"{W}numPr") if props is not None else None
    kinds = [c.get(f"{W}fldCharType") for c in p.iter(f"{W}fldChar")]
    words = [t.text or "" for t in p.iter(f"{W}instrText")]
    images = []
    for inline in p.iter(f"{WP}inline"):
        extent, blip = inline.find(f"{WP}extent"), inline.find(f".//{A}blip")
        images.append({"rel_id": None if blip is None else blip.get(f"{R}embed"), "cx": int(extent.get("cx", 0)) if extent is not None else None, "cy": int(extent.get("cy", 0)) if extent is not None else None})
    return {
        "text": _run_text(p), "texts": [t.text for r in p.iter(f"{W}r") for t in r.findall(f"{W}t") if t.text], "style": _value(props, "pStyle"), "num_id": _value(number, "numId"), "ilvl": _value(number, "ilvl"),
        "field_begin": "begin" in kinds, "field_end": "end" in kinds, "instruction": "".join(words) or None, "has_image": bool(images) or next(p.iter(f"{A}blip"), None) is not None, "images": images,
    }


def read_body(content: bytes) -> list[dict]:
    """Rows of one file: top-level paragraphs and tables, and the paragraphs inside tables (in_body false)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    rows = []
    for i, child in enumerate(body):
        if child.tag == f"{W}p":
            rows.append({"element_index": i, "kind": "p", "in_body": True} | _paragraph(child))
        else:
            if child.tag == f"{W}tbl":
                rows.append({"element_index": i, "kind": "tbl", "in_body": True})
            rows += [{"element_index": i, "kind": "p", "in_body": False} | _paragraph(p) for p in child.iter(f"{W}p")]
    return [r | {"ord": k} for k, r in enumerate(rows)]


def _numbering_parts(z: zipfile.ZipFile, names: set[str]) -> list[dict]:
    rows = []
    attributes = lambda e, end="": {"start": _value(e, "startOverride") or _value(e, "start"), "num_fmt": _value(e, "numFmt" + end), "lvl_text": _value(e, "lvlText" + end), "lvl_jc": _value(e, "lvlJc" + end)}
    if "word/numbering.xml" in names:
        root = ElementTree.fromstring(z.read("word/numbering.xml"))
        for one in root.findall(f"{W}abstractNum"):
            rows += [{"part": "level", "a": one.get(f"{W}abstractNumId"), "b": v.get(f"{W}ilvl")} | attributes(v) for v in one.findall(f"{W}lvl")]
        for num in root.findall(f"{W}num"):
            rows.append({"part": "num", "a": num.get(f"{W}numId"), "b": _value(num, "abstractNumId")})
            rows += [{"part": "override", "a": num.get(f"{W}numId"), "b": v.get(f"{W}ilvl")} | attributes(v) for v in num.findall(f"{W}lvlOverride")]
    if "word/styles.xml" in names:
        for s in ElementTree.fromstring(z.read("word/styles.xml")).findall(f"{W}style"):
            number = s.find(f"{W}pPr/{W}numPr")
            if number is not None and _value(number, "numId") not in (None, "0"):
                rows.append({"part": "style", "a": s.get(f"{W}styleId"), "b": _value(number, "numId"), "c": _value(number, "ilvl") or "0"})
    return rows


def read_parts(content: bytes) -> list[dict]:
    """Numbering, style and image parts of one file as rows tagged by part."""
    rows = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        rows += _numbering_parts(z, names)
        if "word/_rels/document.xml.rels" in names:
            for rel in ElementTree.fromstring(z.read("word/_rels/document.xml.rels")):
                name = "word/" + rel.get("Target", "")
                if rel.get("Type", "").endswith("/image") and name in names:
                    rows.append({"part": "image", "a": rel.get("Id"), "b": name, "blob": z.read(name)})
    return rows


def read_numbered(content: bytes) -> list[dict]:
    """Numbered paragraphs of one file with the level that holds for each, as operators.numbering.numbered_paragraphs has them, and all formats of its list."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
        rows = _numbering_parts(z, set(z.namelist()))
    of = {k: [r for r in rows if r["part"] == k] for k in ("num", "level", "override", "style")}
    over = {(r["a"], r["b"]): r for r in of["override"]}
    held: dict[str, dict[str, dict]] = {}
    for num in of["num"]:
        levels = [r for r in of["level"] if r["a"] == num["b"] and None not in (r["a"], r["b"])]
        own = held.setdefault(num["a"], {})
        for level in levels:
            more = over.get((num["a"], level["b"]), {})
            own[level["b"]] = {k: level[k] if more.get(k) is None else more[k] for k in ATTRIBUTES}
    forms = {num: {int(k): v["num_fmt"] or "decimal" for k, v in levels.items()} for num, levels in held.items()}
    styles = {r["a"]: (r["b"], r["c"]) for r in of["style"]}
    out, at = [], 0
    for child in body:
        at += child.tag == f"{W}tbl"
        for p in [child] if child.tag == f"{W}p" else child.iter(f"{W}p"):
            props = p.find(f"{W}pPr")
            if props is not None:
                number = props.find(f"{W}numPr")
                use = _value(number, "numId"), _value(number, "ilvl")
                num, level = styles.get(_value(props, "pStyle"), (None, None)) if None in use else use
                if num not in (None, "0"):
                    out.append({"ord": at, "use_num": num, "use_lvl": level, "forms": forms.get(num)} | held.get(num, {}).get(level, {}))
            at += 1
    return out


def _scan(found: DataFrame, read, schema: str, failed) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    rows = read(bytes(content))
                except Exception as e:  # noqa: BLE001  any broken file
                    rows = failed(e)
                if rows:
                    yield pd.DataFrame({n: pd.Series([path] * len(rows) if n == "path" else [r.get(n) for r in rows], dtype=object) for n in names})

    return found.where("doc_type = 'docx'").select("path", "content").mapInPandas(scan, schema)


def body(found: DataFrame) -> DataFrame:
    return _scan(found, read_body, PARAGRAPHS, lambda e: [{"kind": "error", "error": f"{type(e).__name__}: {e}"}])


def parts(found: DataFrame) -> DataFrame:
    return _scan(found, read_parts, PARTS, lambda e: [{"part": "error", "a": f"{type(e).__name__}: {e}"}])


def numbered(found: DataFrame) -> DataFrame:
    """Numbered paragraphs of all documents, as read_numbered has them, from one pass over each file; a file that cannot be read gives none."""
    return _scan(found, read_numbered, NUMBERED, lambda e: []).withColumnRenamed("path", "doc_id")


def numbering_tables(found_parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """nums, abstract levels, overrides and styles, as operators.numbering wants them."""
    p, attributes = found_parts.withColumnRenamed("path", "doc_id"), ("start", "num_fmt", "lvl_text", "lvl_jc")
    nums = p.where("part = 'num'").select("doc_id", F.col("a").alias("num_id"), F.col("b").alias("abstract_id"))
    levels = p.where("part = 'level'").select("doc_id", F.col("a").alias("abstract_id"), F.col("b").alias("ilvl"), *attributes)
    over = p.where("part = 'override'").select("doc_id", F.col("a").alias("num_id"), F.col("b").alias("ilvl"), *attributes)
    styles = p.where("part = 'style'").select("doc_id", F.col("a").alias("style_id"), F.col("b").alias("num_id"), F.col("c").alias("ilvl"))
    return nums, levels, over, styles


def images(found_body: DataFrame, found_parts: DataFrame) -> DataFrame:
    """(path, element_index, run_index, width, height, blob, suffix) of inline images; missing parts give no row."""
    runs = found_body.where("in_body").select("path", "element_index", F.posexplode("images").alias("run_index", "i")).select("path", "element_index", "run_index", F.col("i.rel_id").alias("a"), F.col("i.cx").alias("width"), F.col("i.cy").alias("height"))
    held = found_parts.where("part = 'image'").select("path", "a", "blob", F.lower(F.regexp_extract("b", r"(\.[^.]+)$", 1)).alias("suffix"))
    return runs.join(held, ["path", "a"]).drop("a")


def items(found_body: DataFrame, kept_images: DataFrame | None = None, prefixes: DataFrame | None = None) -> DataFrame:
    """(doc_id, element_index, item_pos, type, content): texts, split where merged, page numbers apart, then images; tables as placeholders."""
    p = found_body.where("in_body and kind = 'p'").withColumnRenamed("path", "doc_id")
    if prefixes is not None:
        p = p.join(prefixes, ["doc_id", "ord"], "left").withColumn("text", F.concat(F.coalesce("prefix", F.lit("")), "text"))
    pieces = p.select("doc_id", "element_index", F.posexplode(T.split_paragraph(F.col("text"))).alias("item_pos", "raw"))
    kind = F.when(T.is_page_number_paragraph(F.col("raw")), "page_number").otherwise("text")
    out = pieces.select("doc_id", "element_index", "item_pos", kind.alias("type"), F.translate("raw", " \t", "").alias("content")).where("content <> ''")
    tables = found_body.where("in_body and kind = 'tbl'").select(F.col("path").alias("doc_id"), "element_index", F.lit(0).alias("item_pos"), F.lit("table").alias("type"), F.format_string("{{table_%d}}", F.col("element_index")).alias("content"))
    out = out.unionByName(tables)
    if kept_images is not None:
        mark = F.format_string("{{image_%d_%d}}", F.col("element_index"), F.col("run_index"))
        out = out.unionByName(kept_images.select(F.col("path").alias("doc_id"), "element_index", (F.col("run_index") + 1_000_000).alias("item_pos"), F.lit("image").alias("type"), mark.alias("content")))
    return out
