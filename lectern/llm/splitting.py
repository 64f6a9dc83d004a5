"""Problem 4: split oversized items at natural boundaries.

Method: a sparse-table range-maximum index over the boundary strengths of all cut
positions.  The strongest cut in the permissible window ends a piece, ties go
rightward, and the next piece steps back by the overlap.

Strengths: blank lines 4, line ends 3, sentence ends 2, white space 1, anything else
0; the gap between two units (blank lines, a line break, the white space after a
sentence) may be cut at any of its positions.  Inside a fence no line is blank.

The same index says which boundaries would do: the weakest of the strongest boundaries of
all windows as wide as a piece without its overlap.

A piece has at most ``limit`` characters (code points), the first
``overlap`` of which repeat the end of the piece before; cut without the repeats and put
together, the pieces are the text.  Lengths are linear in the text, whatever its size.

Results: texts up to the limit (null and empty ones too) are single pieces as they stand and
have no boundary class; null text gives no piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.tables import in_batches, one_per_key_in_place

LIMIT, OVERLAP = 2400, 200
#: Names of the strengths 0 to 4; white space inside a sentence isn't a boundary of its own class.
NAMES = ("none", "none", "sentence", "line", "blank")

_SENTENCE = re.compile(r"[.!?](?=\s)|[。！？]")
_GAP = re.compile(r"\s+")


def strengths(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Strength of each cut position 0 .. len(text): of the cuts that may end a piece, and of the places where units begin and end."""
    n = len(text)
    s = np.zeros(n + 1, np.uint8)
    for m in _GAP.finditer(text):
        s[m.start() : m.end() + 1] = 1
    cuts = [m.end() for m in _SENTENCE.finditer(text)]
    s[cuts] = 2
    units = np.zeros(n + 1, np.uint8)
    units[cuts] = 2
    for c in cuts:  # the white space after a sentence belongs to the gap, up to the line's end
        if c < n and text[c] in " \t　 ":
            m = _GAP.match(text, c)
            s[c : m.end() + 1] = 2
    at, fenced = 0, False
    for line in text.split("\n"):
        end = at + len(line)
        bare = line.strip()
        if bare.startswith(("```", "~~~")):
            fenced = not fenced
        if not bare and not fenced:
            # the whole gap around a blank line is a boundary
            a, b, strength = max(at - 1, 0), min(end + 1, n) + 1, 4
        else:
            # before the line break and behind it
            a, b, strength = max(at - 1, 0), at + 1, 3
        for x in (s, units):
            x[a:b] = np.maximum(x[a:b], strength)
        at = end + 1
    return s, units


class RangeMax:
    """Sparse table over the strengths: the strongest position of a window, the rightmost of equals, in constant time."""

    def __init__(self, s: np.ndarray, widest: int) -> None:
        self.levels = [s]
        while 2 << (len(self.levels) - 1) <= min(widest, len(s)):
            below, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.maximum(below[:-half], below[half:]))

    @classmethod
    def placed(cls, s: np.ndarray, widest: int) -> RangeMax:
        """The table whose answers tell the position as well."""
        return cls((s.astype(np.int64) << 40) | np.arange(len(s)), widest)

    def query(self, first: int, last: int) -> tuple[int, int]:
        """(strength, position) in [first, last] of a placed table."""
        k = (last - first + 1).bit_length() - 1
        level = self.levels[k]
        best = int(max(level[first], level[last - (1 << k) + 1]))
        return best >> 40, best & ((1 << 40) - 1)

    def weakest(self, first: int, last: int, width: int) -> int:
        """The least of the strongest cuts of all windows of that width in [first, last], which is at least as wide."""
        k = width.bit_length() - 1
        level, count = self.levels[k], last - first + 2 - width
        other = first + width - (1 << k)
        return int(np.maximum(level[first : first + count], level[other : other + count]).min())


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[str | None, list[tuple[int, int, int]]]:
    """(coarsest boundary whose units all fit, pieces as (start, end, strength of the cut at its end))."""
    n = len(text)
    if n <= limit:
        return None, [(0, n, 4)]
    s, units = strengths(text)
    # a unit is too long if so many positions in a row have no boundary of its class or a coarser one
    fits = limit - overlap
    coarsest = NAMES[RangeMax(units, fits).weakest(1, n - 1, fits)]
    index = RangeMax.placed(s, limit)
    pieces, start, done = [], 0, overlap - 1
    while n - start > limit:
        strength, cut = index.query(done + 1, start + limit)
        pieces.append((start, cut, strength))
        start, done = cut - overlap, cut
    pieces.append((start, n, 4))
    return coarsest, pieces


def split_items(df: DataFrame, key: str, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, boundary) of the rows whose text is over the limit: the coarsest boundary by which it could be cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boundary = [split_text(t, limit, overlap)[0] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(boundary, pa.string())], names=[key, "boundary"])

    long = df.select(key, text).where(F.char_length(text) > limit)
    return in_batches(long, run, f"`{key}` {df.schema[key].dataType.simpleString()}, boundary string")


def pieces(df: DataFrame, key: str, keep: list[str], text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """All items as pieces: key, keep, piece_no, start, text, ends_at (the boundary at its end); items within the limit are one piece. Repeated rows count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for i, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for n, (a, b, strength) in enumerate(split_text(t, limit, overlap)[1], 1):
                    for r, v in zip(rows, (i, n, a, t[a:b], NAMES[strength] if b < len(t) else "end"), strict=True):
                        r.append(v)
            at = pa.array(rows[0], pa.int64())
            made = [pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.string()), pa.array(rows[4], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(batch.num_columns - 1)), *made], names=[key, *keep, "piece_no", "start", text, "ends_at"])

    rows = one_per_key_in_place(df.select(key, *keep, text), key).where(F.col(text).isNotNull())
    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in [key, *keep])
    return in_batches(rows, run, f"{schema}piece_no int, start bigint, `{text}` string, ends_at string")
