"""Distinctive terms of a description."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.words import STOP_WORDS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def distinctive_terms(text: Column) -> Column:
    """Distinct terms: runs of letters, digits and hyphens, trimmed of hyphens, ASCII-lower-cased, of 4 bytes or more, without stop words. Null text has none (empty array)."""
    runs = F.split(F.coalesce(text, F.lit("")), r"[^\p{IsAlphabetic}\p{N}-]+")
    terms = F.transform(runs, lambda w: ascii_lower(F.regexp_replace(w, "^-+|-+$", "")))
    return F.array_distinct(F.filter(terms, lambda w: (F.octet_length(w) >= 4) & ~w.isin(*STOP_WORDS)))
