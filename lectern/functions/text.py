"""Scalar functions on text, as Column builders: everything stays in the JVM but the fingerprint."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Unicode white space, spelled out so that all engines agree.
WS = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same beyond ASCII, and as characters; and white space but for line feeds.
WIDE_WS = r"\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LINE_WS = r"\x{9}\x{B}-\x{D}\x{20}" + WIDE_WS
#: Scripts whose characters count for themselves.
CJK = r"\x{3000}-\x{303F}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}"
#: Code points that show nothing: zero width, direction marks, blank letters, tags.
INVISIBLE = (
    r"\x{200B}-\x{200D}\x{2060}-\x{2064}\x{FEFF}\x{AD}\x{34F}\x{180E}"
    r"\x{200E}-\x{200F}\x{61C}\x{202A}-\x{202E}\x{2066}-\x{2069}"
    r"\x{115F}\x{1160}\x{3164}\x{FFA0}"
    r"\x{E0000}-\x{E007F}"
)
#: Words and characters of those scripts per token.
WORDS_PER_TOKEN, CJK_PER_TOKEN = 0.75, 1.5
#: A page number: up to four digits, or a canonical Roman numeral from 1 to 99.
PAGE_NUMBER = r"^(?:[0-9]{1,4}|(?i:(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})))$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def is_ascii(c: Column) -> Column:
    """A cheap test that lets most texts off the patterns with many ranges, which cost several times as much."""
    return F.octet_length(c) == F.char_length(c)


def trim(c: Column) -> Column:
    """Without white space, of any kind, at both ends."""
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return let(trim(c), lambda t: F.when(is_ascii(t), F.regexp_replace(t, r"\s+", " ")).otherwise(F.regexp_replace(t, f"[{WS}]+", " ")))


def lines(c: Column) -> Column:
    """Lines without their line ends; no last empty line."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(F.regexp_replace(c, r"\n\z", ""), r"\n"), lambda x: F.regexp_replace(x, r"\r\z", "")))


def estimate_tokens(c: Column) -> Column:
    """Tokens a text is likely to cost: words and wide characters over their rates, rounded down. Null text is null."""
    # in ASCII, white space is what the short class says, and nothing is wide
    words = F.regexp_count(F.when(is_ascii(c), c).otherwise(F.regexp_replace(c, f"[{CJK}{WIDE_WS}]", " ")), F.lit(r"\S+"))
    wide = F.when(is_ascii(c), 0).otherwise(F.char_length(c) - F.char_length(F.regexp_replace(c, f"[{CJK}]", "")))
    return F.floor(words / F.lit(WORDS_PER_TOKEN) + wide / F.lit(CJK_PER_TOKEN)).cast("bigint")


def sanitize(c: Column) -> Column:
    """The text without invisible code points."""
    return F.when(is_ascii(c), c).otherwise(F.regexp_replace(c, f"[{INVISIBLE}]", ""))


def invisible_count(c: Column) -> Column:
    return (F.char_length(c) - F.char_length(sanitize(c))).cast("bigint")


def is_page_number(c: Column) -> Column:
    return (trim(c) != "") & trim(c).rlike(PAGE_NUMBER)


def dehyphenate(c: Column) -> Column:
    """Words broken at a line's end, put together."""
    return F.when(F.contains(c, F.lit("-\n")), F.regexp_replace(c, r"([\p{L}\p{N}\p{M}_])-\n([\p{L}\p{N}\p{M}_])", "$1$2")).otherwise(c)


def slug(c: Column) -> Column:
    """ASCII letters and digits in lower case, other runs as one hyphen, at most 64 characters; trimmed before it is cut."""
    plain = F.regexp_replace(c, "[^A-Za-z0-9]+", "-")
    return F.substring(F.lower(F.regexp_replace(plain, r"^-+|-+\z", "")), 1, 64)


def one_line(c: Column, most: int = 160) -> Column:
    flat = squeeze(c)
    return F.when(F.char_length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)


def unquote(c: Column) -> Column:
    """Without one pair of like quotes around it."""
    quoted = (F.char_length(c) >= 2) & (F.left(c, F.lit(1)) == F.right(c, F.lit(1))) & F.left(c, F.lit(1)).isin('"', "'")
    return F.when(quoted, F.substr(c, F.lit(2), F.char_length(c) - 2)).otherwise(c)


def slashes(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def read_slice(c: Column, offset: int, limit: int) -> Column:
    """struct(part, total, next): ``limit`` characters from ``offset``; next is null at the end."""
    n = F.char_length(c)
    to = F.least(n, F.lit(offset + limit))
    return F.struct(F.substring(c, offset + 1, limit).alias("part"), n.cast("bigint").alias("total"), F.when(to < n, to.cast("bigint")).alias("next"))


def page_header(title: Column, url: Column, body: Column) -> Column:
    """A page as a document: its title (else the path of its url), where it came from, its text."""
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return F.concat(F.lit("# "), F.coalesce(title, F.when(path == "", "/").otherwise(path)), F.lit("\n\nsource: "), url, F.lit("\n\n"), body)


def lossy(c: Column) -> Column:
    """Bytes as UTF-8, invalid ones replaced, without a byte-order mark."""
    return F.regexp_replace(F.make_valid_utf8(c.cast("string")), r"^\x{FEFF}", "")


def civil_date(days: Column) -> Column:
    return F.date_from_unix_date(days)


def iso_time(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


_OFFSET, _PRIME, _MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1


def fnv1a(data: bytes, h: int = _OFFSET) -> int:
    """64-bit FNV-1a, from a hash of what comes before."""
    for b in data:
        h = ((h ^ b) * _PRIME) & _MASK
    return h


#: Texts that are folded side by side at least; fewer are folded one by one.
_SIDE_BY_SIDE = 32


def fnv1a_all(texts: list[bytes]) -> list[int]:
    """FNV-1a of many texts: byte position by byte position over all texts that are long enough, longest first."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order], np.int64)
    joined = np.frombuffer(b"".join(texts[i] for i in order), np.uint8).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    h = np.full(len(texts), _OFFSET, np.uint64)
    at, active, prime = 0, int((lengths > 0).sum()), np.uint64(_PRIME)
    with np.errstate(over="ignore"):
        while active >= _SIDE_BY_SIDE:
            # as many texts as now reach to the end of the shortest of them
            end = int(lengths[active - 1])
            for at in range(at, end):
                h[:active] = (h[:active] ^ joined[starts[:active] + at]) * prime
            at = end
            active = int((lengths > at).sum())
    out = [0] * len(texts)
    for k, i in enumerate(order):
        out[i] = fnv1a(texts[i][at:], int(h[k])) if lengths[k] > at else int(h[k])
    return out


@pandas_udf(StringType())
def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """16 hex digits of 64-bit FNV-1a over the UTF-8 bytes. Null stays null."""
    for s in texts:
        there = s.notna()
        hashes = fnv1a_all([t.encode("utf-8", "surrogatepass") for t in s[there]])
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        out[there] = [f"{h:016x}" for h in hashes]
        yield out
