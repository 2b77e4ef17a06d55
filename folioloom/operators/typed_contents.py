"""Contents lists that were typed by hand, told by the look of their lines.

Where such a list ends depends on all entries before, so each document's first
paragraphs, a bounded number, go through one pass in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# How far a list's title, its first entry and its entries are looked for, and what they look like.
TITLE_WITHIN, FIRST_WITHIN, MOST, LOOK_BACK, LOOK_AHEAD, MISSES = 150, 200, 600, 5, 9, 10
TITLES = ("目录", "Contents", "CONTENTS")
CHAPTER = r"第[一二三四五六七八九十\d]+章"
FIRST_ENTRY = r"第[一二三四五六七八九十\d]+[卷章].*?\d+|\d+\.\s*[^.]+\d+$"
LED_PAGE = r"\.{2,}(\d+)"
NUMBERED_ENTRY = r"(\d+(?:\.\d+)*[^\d]+?)(?:\.{2,}|\s+)(\d+)(?=(?:\d+(?:\.\d+)*|[一-鿿]|$))"
LISTED = r"[一二三四五六七八九十]+、"
BEFORE_PAGE = "）)、。.…"
HAN = re.compile("[一-鿿]")
#: A line with more characters than this holds more than one entry even if it has one page.
LONG_ENTRY, LONG_LINE, LEAST_LINE, MOST_PAGE = 50, 100, 2, 10_000
BLANKS = str.maketrans("", "", " 　\t")

Entry = tuple[int | None, str, str | None]


def _level(text: str) -> int | None:
    dotted = re.match(r"\d+(?:\.\d+)*", text)
    return dotted[0].count(".") + 1 if dotted else None


def _entry(text: str, page: str | None) -> Entry | None:
    """Without the dots that lead to a page; None where nothing else is there."""
    text = re.sub(r"\.{2,}$", "", text.strip()).strip() if page else text.strip()
    return (_level(text), text, page) if text else None


def page_at_end(line: str, strict: bool = False) -> str | None:
    """Digits at a line's end behind dots, a blank, a mark or Han; unless strict, also behind anything in a line with Han."""
    digits = re.search(r"\d+$", line)
    before = line[: digits.start()] if digits else ""
    if not before:
        return None
    if before.endswith("..") or before[-1].isspace():
        return digits[0]
    near = before[-1] in BEFORE_PAGE or HAN.match(before[-1]) or (not strict and len(before) > 2 and HAN.search(before))
    return digits[0] if near and 1 <= int(digits[0]) <= MOST_PAGE else None


def several(line: str) -> list[Entry] | None:
    """The entries of a line that holds more than one, or one and something else; None for other lines."""
    spots = list(re.finditer(LED_PAGE, line))
    if len(spots) > 1 or (spots and len(line) > LONG_ENTRY):
        starts = [0, *(s.end() for s in spots)]
        return [e for at, s in zip(starts, spots) if (e := _entry(line[at : s.start()], s[1]))]
    found = list(re.finditer(NUMBERED_ENTRY, line))
    if len(found) > 1 or (found and len(found[0][0]) < 0.9 * len(line)):
        return [e for m in found if (e := _entry(m[1], m[2]))]
    return None


def single(line: str) -> Entry | None:
    page, listed = page_at_end(line), re.match(LISTED, line)
    if not (page or listed or ".." in line):
        return None
    found = _entry(line[: -len(page)] if page else line, page)
    return (1, *found[1:]) if found and listed and found[0] is None else found


def opening(lines: list[str]) -> int | None:
    """Where entries start: behind a title, else at the first line that looks like an entry, or behind a title a little before it."""
    for at, line in enumerate(lines[:TITLE_WITHIN]):
        tight = line.translate(BLANKS)
        if any(t in line for t in TITLES) and (tight in TITLES or tight.startswith(TITLES[0])):
            return at + 1
    for at, line in enumerate(lines[:FIRST_WITHIN]):
        if re.match(FIRST_ENTRY, line):
            return next((k + 1 for k in range(max(0, at - LOOK_BACK), at) if TITLES[0] in lines[k]), at)
    return None


def _body_begins(ahead: list[str], found: list[tuple[int, int, Entry]]) -> bool:
    """Whether a chapter that is already listed comes before any further line with a page."""
    for line in filter(None, ahead):
        chapter = re.match(CHAPTER, line)
        if chapter and any(chapter[0] in text for _, _, (_, text, _) in found):
            return True
        if page_at_end(line, strict=True):
            return False
    return False


def listed(lines: list[str]) -> list[tuple[int, int, Entry]]:
    """(line, place in it, entry) of a document's typed contents list; lines are its first paragraphs, stripped."""
    start, found, missed = opening(lines), [], 0
    for at in range(start, min(start + MOST, len(lines))) if start is not None else ():
        line = lines[at]
        blank = len(line) < LEAST_LINE
        many = None if blank else several(line)
        one = None if blank or many is not None else single(line)
        if many:
            found += [(at, k, e) for k, e in enumerate(many)]
            missed = 0
        elif one:
            found.append((at, 0, one))
            missed = 0
            if _body_begins(lines[at + 1 : at + 1 + LOOK_AHEAD], found):
                break
        elif many is None:
            # A short line with a digit may still belong to the list.
            missed = missed + 1 if blank or len(line) > LONG_LINE or not any(c.isdigit() for c in line) else 0
            if missed >= MISSES and found:
                break
    return found


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["doc_id", "ord", "part", "level", "text", "page"]
    for frame in frames:
        rows = [(doc, ords[at], k, level, text, page) for doc, ords, lines in zip(frame["doc_id"], frame["ords"], frame["lines"]) for at, k, (level, text, page) in listed([str(x).strip() for x in lines])]
        if rows:
            made = pd.DataFrame(rows, columns=names)
            yield made.astype({"level": "Int32"})


def entries(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, ord, part, level, text, page) of typed lists; part counts the entries of one paragraph.

    paragraphs: doc_id, ord, texts. Documents that show neither a title nor a
    first entry stay in the JVM. Dots before a page are no part of a title.
    """
    upto = MOST + FIRST_WITHIN + LOOK_AHEAD
    lines = paragraphs.select("doc_id", "ord", F.coalesce(F.array_join("texts", ""), F.lit("")).alias("line"))
    first = lines.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).where(F.col("nth") <= upto)
    opens = (F.col("nth") <= FIRST_WITHIN) & F.col("line").rlike(rf"{'|'.join(TITLES)}|(?U)^\s*(?:{FIRST_ENTRY[:-1]})")
    one = first.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("x"), F.bool_or(opens).alias("opens")).where("opens")
    kinds = dict(paragraphs.dtypes)
    return one.select("doc_id", F.col("x.ord").alias("ords"), F.col("x.line").alias("lines")).mapInPandas(_rows, f"doc_id {kinds['doc_id']}, ord {kinds['ord']}, part int, level int, text string, page string")
