"""Chapter headings in several languages, and the structure they make."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from lectern.functions.text import WS, lines, trim

#: How long a heading may be, how far a table of contents is looked for, how many headings are shown.
MOST_CHARS, TOC_CHARS, SAMPLE = 80, 30_000, 10
MOST_ROMAN, MOST_CHINESE = 200, 999
#: Words for a chapter.
CHAPTER = r"(?:chapter|chapitre|kapitel|cap[ií]tulo|capitolo|hoofdstuk|ch\.?)"
_NUMERALS = "0-9０-９〇零一二两三四五六七八九十百千"
_UPPER = "A-ZÀ-Þ"
#: Lines that head a table of contents.
TOC = r"(?imu)^[<WS>]*(?:table of contents|contents|índice|sumário|table des matières|inhaltsverzeichnis|indice|sommario|inhoudsopgave|目[ \t　]*(?:录|錄|次))[<WS>]*$".replace("<WS>", WS)

_ROMAN_SIGNS = ((100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def roman(n: int) -> str:
    out = ""
    for value, sign in _ROMAN_SIGNS:
        while n >= value:
            out, n = out + sign, n - value
    return out


ROMAN = {roman(n): n for n in range(1, MOST_ROMAN + 1)}


def _table(pairs: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def roman_to_int(c: Column) -> Column:
    """Canonical numerals up to 200; null for others."""
    return F.try_element_at(_table(ROMAN), F.upper(c))


def chinese_to_int(c: Column) -> Column:
    """Numerals from 1 to 999: digits of either width, or digits with units; null for others."""
    plain = F.translate(c, "０１２３４５６７８９", "0123456789")
    digits, units = _table(dict(zip("〇零一二两三四五六七八九", (0, 0, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9), strict=True))), _table({"十": 10, "百": 100, "千": 1000})
    start = F.struct(F.lit(0).alias("done"), F.lit(0).alias("now"), F.lit(True).alias("ok"))

    def step(acc: Column, x: Column) -> Column:
        v, u = F.try_element_at(digits, x), F.try_element_at(units, x)
        return F.struct(
            F.when(v.isNull() & u.isNotNull(), acc["done"] + F.when(acc["now"] == 0, 1).otherwise(acc["now"]) * u).otherwise(acc["done"]).alias("done"),
            F.when(v.isNotNull(), v).when(u.isNotNull(), 0).otherwise(acc["now"]).alias("now"),
            (acc["ok"] & (v.isNotNull() | u.isNotNull())).alias("ok"),
        )

    composed = F.aggregate(F.regexp_extract_all(plain, F.lit("(?s)(.)"), F.lit(1)), start, step, lambda acc: F.when(acc["ok"], acc["done"] + acc["now"]))
    n = F.when(plain.rlike("^[0-9]{1,9}$"), plain.try_cast("int")).otherwise(composed)
    return F.when(n.between(1, MOST_CHINESE), n)


def _match(s: Column) -> Column:
    """The chapter number of a trimmed line without a heading mark."""

    def group(pattern: str, n: int = 1) -> Column:
        return F.nullif(F.regexp_extract(s, pattern, n), F.lit(""))

    # what follows the number ends it: nothing, punctuation, or a title in capitals
    tail = rf"(?:[{WS}]*$|[{WS}]*[.:\-—–]|[{WS}]+[{_UPPER}0-9\"“(])"
    word = rf"^(?iu:{CHAPTER})[{WS}]*"
    arabic = group(rf"{word}(\d{{1,2}})(?![\p{{L}}\p{{N}}_]){tail}")
    by_word = group(rf"{word}([IVXLCDMivxlcdm]{{1,7}})(?![\p{{L}}\p{{N}}_]){tail}")
    alone = group(rf"^([IVXLCDM]+)[{WS}]*[:.][{WS}]+[{_UPPER}0-9\"“(]")
    small = group(rf"^#{{1,6}}[{WS}]+([ivxlcdm]+)[{WS}]*[:.][{WS}]+[A-Za-zÀ-Þ\"“(]")
    chinese = group(rf"^第[{WS}]*([{_NUMERALS}]+)[{WS}]*[章回卷节篇讲]")
    marked = group(rf"^#{{1,6}}[{WS}]+第?[{WS}]*([{_NUMERALS}]+)[{WS}]*[·、.:：章回卷节篇讲]")
    thai = group(rf"^(?:#{{1,6}}[{WS}]+)?(?:บทที่|ตอนที่|ภาคที่|บท|ตอน|ภาค)[{WS}]*([0-9๐-๙]+)(?![\p{{L}}\p{{N}}\p{{M}}_])")
    korean = group(rf"^(?:#{{1,6}}[{WS}]+)?제[{WS}]*([0-9]+)[{WS}]*[장편절관](?:[{WS}]*의[{WS}]*[0-9]+)?(?:[{WS}]*$|[.:\-]|[{WS}]+[^{WS}])")
    return (
        F.when(F.char_length(s) > MOST_CHARS, None)
        .when(arabic.isNotNull(), arabic.try_cast("int"))
        .when(by_word.isNotNull(), roman_to_int(by_word))
        .when(F.coalesce(alone, small).isNotNull(), roman_to_int(F.coalesce(alone, small)))
        .when(F.coalesce(chinese, marked).isNotNull(), chinese_to_int(F.coalesce(chinese, marked)))
        .when(thai.isNotNull(), F.translate(thai, "๐๑๒๓๔๕๖๗๘๙", "0123456789").try_cast("int"))
        .when(korean.isNotNull(), korean.try_cast("int"))
    )


#: Lines that can be a heading at all; only these go through the forms.
MAYBE = rf"(?iu)^[{WS}]*(?:[#=]{{1,6}}[{WS}]+)?[{WS}]*(?:{CHAPTER}|[ivxlcdm]+[{WS}]*[:.]|第|제|บท|ตอน|ภาค|[{_NUMERALS}]+[{WS}]*[·、.:：章回卷节篇讲])"


def chapter_number(line: Column) -> Column:
    """The number of a chapter heading, with or without a heading mark before it; null for other lines."""
    s = trim(line)
    bare = F.regexp_replace(s, rf"^(?:#{{1,6}}|={{1,6}})[{WS}]+", "")
    return F.when(s.rlike(MAYBE), F.coalesce(_match(s), F.when(bare != s, _match(trim(bare)))))


def has_toc(text: Column) -> Column:
    return F.left(text, F.lit(TOC_CHARS)).rlike(TOC)


_RULE = re.compile(r"={2,}|-{2,}")
_ATX = re.compile(r"(#{1,6}|={1,6})\s+(.+?)\s*#*")


def structural_titles(text: str) -> dict[int, set[str]]:
    """Distinct titles by depth, outside fences: lines with a heading mark, and lines underlined at full length."""
    found: dict[int, set[str]] = {}
    fenced, above = False, ""
    for line in text.split("\n"):
        s = line.strip()
        if s.startswith(("```", "~~~")):
            fenced, above = not fenced, ""
            continue
        if fenced:
            continue
        if s[:1] in {"=", "-"} and _RULE.fullmatch(s) and above and not _RULE.fullmatch(above) and len(s) >= len(above):
            found.setdefault(1 if s[0] == "=" else 2, set()).add(above.lower())
            above = ""
        elif s[:1] in {"#", "="} and (m := _ATX.fullmatch(s)):
            title = m.group(2).strip().lower()
            if title and not ("0" <= title[0] <= "9") and any(c.isalnum() or c == "_" for c in title):
                found.setdefault(len(m.group(1)), set()).add(title)
            above = ""
        else:
            above = s
    return found


def count_titles(found: dict[int, set[str]]) -> int:
    """Titles at the shallowest depth that has two or more; else of all depths."""
    return next((len(found[k]) for k in sorted(found) if len(found[k]) >= 2), sum(map(len, found.values())))


@pandas_udf(LongType())
def structural_count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A fold over a text's lines, which as an expression would cost a hundred times as much.  Null stays null."""
    for s in texts:
        yield s.map(lambda t: None if t is None else count_titles(structural_titles(t))).astype("Int64")


def structure(text: Column) -> Column:
    """struct(chapters, sample, has_toc): distinct chapter numbers, else structural headings; the first ten chapter lines."""
    heads = F.filter(F.transform(lines(text), lambda x: F.struct(chapter_number(x).alias("n"), trim(x).alias("line"))), lambda h: h["n"].isNotNull())
    numbers = F.size(F.array_distinct(F.transform(heads, lambda h: h["n"]))).cast("bigint")
    return F.struct(
        F.when(numbers > 0, numbers).otherwise(structural_count(text)).alias("chapters"),
        F.slice(F.transform(heads, lambda h: h["line"]), 1, SAMPLE).alias("sample"),
        has_toc(text).alias("has_toc"),
    )
