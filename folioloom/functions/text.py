"""Text functions: Column in, Column out, all in generated or built-in JVM code but NFKC and font names."""

from __future__ import annotations

import ast
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Character classes, patterns and words of the formats handled.
HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"
PUNCTUATION = r"[\p{P}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]"
ROMAN = "[IVXLCDMivxlcdm]"
PAGE_FORMS_BOTH = (
    r"第\d+页", r"第\d+页/共\d+页", rf"第{ROMAN}+页", r"Page\s*\d+", rf"Page\s*{ROMAN}+", r"P\.?\s*\d+", rf"P\.?\s*{ROMAN}+", r"\d+/\d+", r"-\s*\d+\s*-", rf"-\s*{ROMAN}+\s*-",
    r"\d+\s*/\s*\d+", rf"{ROMAN}+\s*/\s*{ROMAN}+",
)
PAGE_FORMS_PDF = (*PAGE_FORMS_BOTH, r"-\s*第\d+页\s*-", rf"-\s*第{ROMAN}+页\s*-")
HAN_DIGITS = "一二三四五六七八九"
NUMERAL = "[一二三四五六七八九十百千万]+"
TITLE_STOPS = r"[.…·•▪▫○●□■◆◇▲△★☆・\-—–_=~|│┃┄┅┈┉─━。，]"
ORDINALS = (
    r"\d+\.(?:\.\d+)*", r"\(\d+\)", r"（\d+）", r"\(\d+\.(?:\.\d+)*\)", r"（\d+\.(?:\.\d+)*）", r"\d+\)", r"\d+）", r"\d+\.(?:\.\d+)*\)", r"\d+\.(?:\.\d+)*）",
    rf"{NUMERAL}、?", rf"第{NUMERAL}、?", rf"（{NUMERAL}）、?", rf"{NUMERAL}）、?", rf"第{NUMERAL}章、?", rf"第{NUMERAL}节、?",
    r"(?:附件|附|附录)\d+", r"(?:附件|附|附录)\d+\.(?:\.\d+)*", rf"(?:附件|附|附录){NUMERAL}", r"(?:附件|附|附录)[A-Za-z]", rf"(?:附件|附|附录){ROMAN}+",
)
SENTENCE_ENDS = "[。.；;！!？?：:]"
HEADINGS = (
    r"(第[一二三四五六七八九十百千]+章).*", r"(第[一二三四五六七八九十百千]+卷).*", r"(第[一二三四五六七八九十百千]+节).*", r"(第[一二三四五六七八九十百千]+册).*", r"(第[一二三四五六七八九十百千]+部分).*",
    r"[一二三四五六七八九十百千]+、\S.*", r"[0-9]+、\S.*", r"[0-9]+[^.\d）)]\S.*", r"[0-9]+\.[^.\d]\S.*", r"（[一二三四五六七八九十百千]+）\S.*",
)
IMAGE_SUFFIXES = {"image/png": ".png", "image/jpeg": ".jpg", "image/jpg": ".jpg", "image/gif": ".gif", "image/bmp": ".bmp", "image/x-emf": ".emf", "image/x-wmf": ".wmf"}
CHINESE_FORMATS = ("chineseCounting", "chineseCountingThousand", "japaneseCounting")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


@pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility normalisation, which Spark lacks; ASCII texts pass untouched."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def collapse_punctuation(c: Column) -> Column:
    """Runs of one punctuation mark become one."""
    return F.regexp_replace(c, rf"({PUNCTUATION})\1+", "$1")


def collapse_fourfold(c: Column) -> Column:
    """Left to right, four equal characters become one."""
    return F.regexp_replace(c, r"(?U)([^\s\p{C}])\1{3}", "$1")


def halve_pairs(c: Column) -> Column:
    """Texts all of whose Han characters come in pairs, of at least two kinds side by side, are halved."""
    halved = F.regexp_replace(c, rf"({HAN})\1", "$1")
    rest = F.regexp_replace(c, rf"({HAN})\1", "")
    return F.when(~rest.rlike(HAN) & halved.rlike(rf"({HAN})(?!\1){HAN}"), halved).otherwise(c)


def tidy_spaces(c: Column) -> Column:
    """White space goes unless ASCII letters or digits stand on both sides."""
    return F.regexp_replace(c, r"(?U)(?<![A-Za-z0-9\s])\s++|(?U)(?<!\s)\s++(?![A-Za-z0-9])", "")


def drop_controls(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, " ", " "), r"[\p{C}\x{fffd}]", "")


def normalize(c: Column) -> Column:
    return tidy_spaces(collapse_punctuation(collapse_fourfold(halve_pairs(drop_controls(nfkc(c))))))


def clean_line(c: Column) -> Column:
    """The writers' second pass over every line."""
    return collapse_fourfold(halve_pairs(c))


def _short_number(c: Column) -> Column:
    return c.rlike(r"(?U)^\d{1,4}\z") | c.rlike(rf"^{ROMAN}{{1,10}}\z")


def _mostly_number(c: Column) -> Column:
    n = F.length(c)
    digits, roman = F.length(F.regexp_replace(c, r"(?U)\D", "")), F.length(F.regexp_replace(c, "[^IVXLCDMivxlcdm]", ""))
    return n.between(1, 10) & ((digits > 0.7 * n) | (roman > 0.7 * n))


def _formed(c: Column, forms) -> Column:
    return c.rlike(rf"(?iU)^(?:{'|'.join(forms)})\z")


def is_page_number(c: Column) -> Column:
    """Of a line of a page layout; null counts as no number."""
    bare, tight = strip(c), F.regexp_replace(c, r"(?U)\s+", "")
    found = _short_number(tight) | _formed(bare, PAGE_FORMS_PDF) | _formed(tight, PAGE_FORMS_PDF) | _mostly_number(tight)
    return F.coalesce(F.length(tight).between(1, 20) & found, F.lit(False))


def is_page_number_paragraph(c: Column) -> Column:
    """Of a paragraph of a flowing document."""
    bare = strip(c)
    return F.coalesce(F.length(c).between(1, 20) & (_short_number(bare) | _formed(bare, PAGE_FORMS_BOTH) | _mostly_number(bare)), F.lit(False))


def in_bottom_region(bottom: Column, height: Column, share: float = 0.1) -> Column:
    return F.coalesce((height > 0) & (bottom >= height * (1 - share)), F.lit(False))


def is_contents_item(c: Column) -> Column:
    """Ends in digits after something else."""
    return F.coalesce(strip(c).rlike(r"(?U)\D\d+\z"), F.lit(False))


def contents_title(c: Column) -> Column:
    """Up to the first separator, else up to an ideographic space; digits at its end go."""
    left = F.regexp_replace(c, r"(?U)^\s+", "")
    head = F.when(left.rlike(TITLE_STOPS), F.regexp_extract(left, rf"(?s)^(.*?){TITLE_STOPS}", 1)).when(left.contains("　"), F.substring_index(left, "　", 1)).otherwise(left)
    return F.coalesce(strip(F.regexp_replace(strip(head), r"(?U)\d+\z", "")), F.lit(""))


def is_heading(c: Column, pattern: str | None = None) -> Column:
    return F.coalesce(c.rlike(rf"(?U)^(?:{pattern or '|'.join(HEADINGS)})"), F.lit(False))


def _leading_number(c: Column) -> Column:
    """Digits, or a Han numeral up to 99, at the start; else null."""
    value = lambda x: F.element_at(F.create_map(*[F.lit(v) for i, h in enumerate(HAN_DIGITS) for v in (h, i + 1)]), x)
    tens, ones, one = F.regexp_extract(c, f"^([二三四五六七八九]?)十", 1), F.regexp_extract(c, f"^[二三四五六七八九]?十([{HAN_DIGITS}]?)", 1), F.regexp_extract(c, f"^([{HAN_DIGITS}])", 1)
    arabic = F.regexp_extract(c, r"(?U)^(\d+)", 1)
    han = F.when(c.rlike("^[二三四五六七八九]?十"), F.coalesce(value(F.when(tens != "", tens)), F.lit(1)) * 10 + F.coalesce(value(F.when(ones != "", ones)), F.lit(0))).when(one != "", value(F.when(one != "", one)))
    return F.coalesce(F.when(arabic != "", arabic.cast("decimal(38,0)").cast("bigint")), han.cast("bigint"))


def ordinal_value(c: Column) -> Column:
    """The number a heading starts with, else one in parentheses, else that of a numbered chapter, section and so on."""
    inner = F.regexp_extract(c, r"(?U)[（(]([一二三四五六七八九十百千万\d]+)[）)]", 1)
    unit = F.regexp_extract(c, r"(?U)第([一二三四五六七八九十百千万\d]+)(?:章|节|条|项|部分|编|卷|篇|部|册)", 1)
    return F.coalesce(_leading_number(c), _leading_number(inner), _leading_number(unit))


def split_paragraph(c: Column) -> Column:
    """Array of the paragraphs that were merged into one: cut where an ordinal follows a sentence's end and white space."""
    marked = F.regexp_replace(c, rf"(?U)({SENTENCE_ENDS})\s+({'|'.join(ORDINALS)})", "$1\u0001$2")
    return F.filter(F.transform(F.split(marked, "\u0001"), strip), lambda x: x != "")


def percent_numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"%(\d+)"), F.lit(1)), lambda x: x.cast("int"))


def max_placeholder(c: Column) -> Column:
    """The greatest level that a level text names, null where it names none."""
    return F.array_max(percent_numbers(c))


def number_depth(c: Column) -> Column:
    """Parts of the dotted number a heading starts with; 1 for a Han numeral; else null."""
    dotted = F.regexp_extract(c, r"^(\d+(?:\.\d+)*)", 1)
    return F.when(dotted != "", F.size(F.split(dotted, r"\."))).when(c.rlike(f"^第?{NUMERAL}"), 1)


def image_suffix(content_type: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in IMAGE_SUFFIXES.items() for x in pair])
    return F.coalesce(F.element_at(known, content_type), F.lit(".png"))


def file_type(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.endswith(".pdf"), "pdf").when(low.endswith(".docx"), "docx").otherwise("unknown")


def _roman(n: Column, most: int = 3999) -> Column:
    places = (("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"), ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"))
    rest = [F.element_at(F.array(*map(F.lit, p)), (F.floor(n / 10**k) % 10 + 1).cast("int")) for k, p in enumerate(places)]
    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), *reversed(rest))


def _letters(n: Column) -> Column:
    """Bijective base 26; seven letters hold any integer. Place k is there from the sum of the powers up to k on."""
    n, out = n.cast("long"), []
    for k in range(6, -1, -1):
        least = (26 ** (k + 1) - 1) // 25
        out.append(F.when(n >= least, F.chr((65 + F.floor((n - least) / 26**k) % 26).cast("int"))).otherwise(""))
    return F.concat(*out)


def _han_number(n: Column) -> Column:
    """Han numerals below 10,000; a leading 一十 is written 十; zeros between digits once."""
    text = F.lit("")
    for k, unit in ((3, "千"), (2, "百"), (1, "十"), (0, "")):
        d = (F.floor(n / 10**k) % 10).cast("int")
        digit = F.element_at(F.array(*map(F.lit, HAN_DIGITS)), F.greatest(d, F.lit(1)))
        text = F.concat(text, F.when(d > 0, F.concat(digit, F.lit(unit))).otherwise("零"))
    text = F.regexp_replace(F.regexp_replace(text, "零+", "零"), "^零|零$", "")
    return F.regexp_replace(text, "^一十", "十")


def format_number(n: Column, form: Column) -> Column:
    """A list number in a word processor's number format; empty for less than 1 or unknown formats; Han numerals up to 9,999."""
    han = F.when(n < 10_000, _han_number(n)).otherwise(n.cast("string"))
    text = (
        F.when(form == "decimal", n.cast("string")).when(form == "upperRoman", _roman(n)).when(form == "lowerRoman", F.lower(_roman(n)))
        .when(form == "upperLetter", _letters(n)).when(form == "lowerLetter", F.lower(_letters(n))).when(form.isin(*CHINESE_FORMATS), han).when(form == "bullet", "•")
    )
    return F.when(n < 1, "").otherwise(F.coalesce(text, F.lit("")))


@pandas_udf(StringType())
def clean_font_name(names: pd.Series) -> pd.Series:
    """Font names that are the text of a bytes literal are decoded; others pass."""

    def clean(name):
        if name is None or name[:2] not in ("b'", 'b"'):
            return name
        try:
            raw = ast.literal_eval(name)
        except (ValueError, SyntaxError):
            return name
        for code in ("utf-8", "gbk", "gb2312", "gb18030", "latin1"):
            try:
                return raw.decode(code)
            except UnicodeDecodeError:
                continue
        return name

    return names.map(clean)
