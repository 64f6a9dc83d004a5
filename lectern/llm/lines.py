"""Problem 3: lines repeated across the documents of one source.

Method: mask numbers, dates and names, cluster the lines of each source by
locality-sensitive hashing (MinHash of five-word shingles, Jaccard of 0.8 or
more) and remove clusters that occur in many files.

A line's *form* is the project's normal form (``forms``).  Its *mask* is the form
with digits as 0 and each date and each run of capitalised words as one sign; it is what is shingled
and signed.  Forms of a source meet in bands of two min-hashes.  A band's form of the most
files is its lead; every form is compared with the leads of all its bands, by
their min-hashes and where half of these agree by the overlap of all their shingles (16-bit
hashes), and joins the strongest that it is a near copy of.  Forms that neither joined
nor were joined, because unlike forms of more files led their bands, meet once more in narrower
bands, where fewer unlike ones are.  A form whose lead joined another goes with it.

Recall: two forms of a Jaccard of 0.8 share one of the four bands of two min-hashes with a probability of
0.983, and one of the fourteen of four with 0.953; half of their min-hashes agree with 0.99; more above.  A line of less than five
words is a single shingle.

Lines are read, normalised and signed in Arrow batches; what is shuffled is hashes, never text.
A file contributes each form once.

Skew: sums are partial before the shuffle, bands are joined by the engine's own skew join, and
the lines are joined with what is removed of them on (form, one of ``SALTS``), so a line that
stands in every file of a source doesn't gather in one task.

Results: null and empty text have no lines; a file without a known source
has none either; repeated rows of a file count once; of several sources given
for one file the least is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.sources.tables import in_batches, sieve, stored

MIN_FILES = 8
MIN_CHARS = 20
SHINGLE = 5
#: Min-hashes of 16 bits, four to a signature word.
HASHES = 8
#: The bands, wide ones first: four pairs of min-hashes, then fours so that any three min-hashes are together in one.
BANDS = (
    ((0, 1), (2, 3), (4, 5), (6, 7)),
    tuple(x for x in combinations(range(HASHES), 4) if x[0] ^ x[1] ^ x[2] ^ x[3] == 0),
)
JACCARD = 0.8
#: Min-hashes that must agree before the shingles are fetched.
AGREE = 4
#: Tasks that the lines of one form are dealt out to.
SALTS = 16

_DIGITS, _SPACE = re.compile(r"\d+"), re.compile(r"[^\S\n]+")


def forms(text: str) -> Iterator[tuple[int, str, str]]:
    """(line number, form, line before lower-casing) of the lines of a text that can count as repeated."""
    fenced = False
    lines = _SPACE.sub(" ", _DIGITS.sub("0", text.replace("\u200b", "").replace("\xad", ""))).split("\n")
    for n, line in enumerate(lines, 1):
        line = line.strip()
        if line.startswith(("```", "~~~")):
            fenced = not fenced
            continue
        if fenced or len(line) < MIN_CHARS or line[0] == "#":
            continue
        if not (line[0].isalnum() and line[-1].isalnum()):
            i, j = 0, len(line)
            while i < j and not line[i].isalnum():
                i += 1
            while j > i and not line[j - 1].isalnum():
                j -= 1
            line = line[i:j]
        form = line.lower()
        if len(form) >= MIN_CHARS:
            yield n, form, line


#: Names of months and their abbreviations.
MONTHS = frozenset(
    "january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec "
    "januar februar märz mai juni juli oktober dezember janvier février mars avril juin juillet août septembre octobre novembre décembre "
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
)
#: Words inside dates, and what ends a day's number.
_WITHIN, _DAY = frozenset("de of del".split()), re.compile(r"0(?:st|nd|rd|th|er|º|\.)?$")
_NAME, _DATE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _flags(word: str) -> int:
    """1: capitalised; 2: a month; 4: a number; 8: a word inside dates."""
    bare = word.strip(".,;:()").lower()
    return (1 if word[:1].isupper() else 0) | (2 if bare in MONTHS else 0) | (4 if _DAY.match(bare) else 0) | (8 if bare in _WITHIN else 0)


class Signer:
    """Masks, shingles and MinHash signatures of lines, for whole batches at a time."""

    def __init__(self) -> None:
        self.hashes: dict[str, tuple[int, int]] = {}
        rng = np.random.default_rng(7)
        self.mul = rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
        self.add = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)

    def masked(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The signs of the masked lines, one after the other, and how many each line has."""
        split = [x.split(" ") for x in lines]
        words = [w for x in split for w in x]
        if len(self.hashes) > 1_000_000:
            self.hashes.clear()
        for w in set(words).difference(self.hashes):
            self.hashes[w] = (xxhash.xxh3_64_intdigest(w.lower()), _flags(w))
        known = [*map(self.hashes.__getitem__, words)]
        h = np.fromiter((x for x, _ in known), np.uint64, len(known))
        flags = np.fromiter((x for _, x in known), np.int8, len(known))
        line_of = np.repeat(np.arange(len(lines)), np.fromiter(map(len, split), np.int64, len(split)))
        same = line_of[1:] == line_of[:-1]

        def beside(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            """Whether x stands at a place and y at one beside it in the line."""
            out = np.zeros(len(x), bool)
            out[1:] |= x[1:] & y[:-1] & same
            out[:-1] |= x[:-1] & y[1:] & same
            return out

        month, number, within = (flags & 2) > 0, (flags & 4) > 0, (flags & 8) > 0
        # a month with a number beside it, the numbers beside that, and the words that hold them together
        date = beside(month, number | within)
        for _ in range(2):
            date |= beside(number, date) | beside(within, date)
        # words inside dates that stand at their edges are none
        date &= ~within | beside(number | month, within) | beside(within, number | month)
        upper = (flags & 1) > 0
        name = beside(upper, upper) & ~date
        h = np.where(date, _DATE, np.where(name, _NAME, h))
        again = np.zeros(len(h), bool)
        again[1:] = same & (h[1:] == h[:-1]) & (date | name)[1:]
        keep = ~again
        return h[keep], np.bincount(line_of[keep], minlength=len(lines))

    def __call__(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per line its mask and two signature words of four 16-bit min-hashes each; 16-bit hashes of the shingles of all lines, and where each line's begin."""
        if not lines:
            none = np.zeros(0, np.int64)
            return none, np.zeros((0, 2), np.int64), none.astype(np.int16), np.zeros(1, np.int64)
        h, sizes = self.masked(lines)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        ends = np.repeat(starts + sizes, sizes)
        with np.errstate(over="ignore"):
            # the mask: a sum over its signs and their places
            at = (np.arange(len(h)) - np.repeat(starts, sizes)).astype(np.uint64)
            mixed = (h ^ (h >> np.uint64(31))) * (at * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))
            mask = np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), starts)
            rolled = h.copy()
            left = ends - np.arange(len(h))  # signs from here to the line's end
            for k in range(1, SHINGLE):
                nxt = np.zeros_like(h)
                nxt[: len(h) - k] = h[k:]
                rolled = rolled * np.uint64(0x100000001B3) + np.where(left > k, nxt, np.uint64(k))
            # a line of five signs or more has only whole shingles; a shorter one is a single shingle
            whole = np.repeat(sizes, sizes)
            rolled = rolled[(left >= SHINGLE) | ((whole < SHINGLE) & (left == whole))]
            n = np.maximum(sizes - SHINGLE + 1, 1)
            first = np.concatenate([[0], np.cumsum(n)])
            mixed = rolled ^ (rolled >> np.uint64(29))
            out = np.zeros((len(lines), 2), np.uint64)
            for k in range(HASHES):
                least = np.minimum.reduceat((mixed * self.mul[k] + self.add[k]) >> np.uint64(20), first[:-1])
                out[:, k // 4] |= (least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)) << np.uint64(16 * (k % 4))
            shingles = ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.uint16).view(np.int16)
        return mask.view(np.int64), out.view(np.int64), shingles, first


_LINE = "line_no:int,form:bigint,mask:bigint,fresh:int,s0:bigint,s1:bigint"
_MASK = "mask:bigint,shingles:array<smallint>"


def file_lines(df: DataFrame, key: str = "file_id", text: str = "text") -> DataFrame:
    """(key, lines, masks) per row.  lines: line_no, form and mask as 64-bit hashes, fresh (1 at the text's first line of that form), signature.  masks: the shingles of each mask, at least once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signer()
        told: set[int] = set()
        for batch in batches:
            per, numbers, hashes, raw = [], [], [], []
            for t in batch.column(1).to_pylist():
                before = len(numbers)
                for n, form, line in forms(t) if t else ():
                    numbers.append(n)
                    hashes.append(xxhash.xxh3_64_intdigest(form))
                    raw.append(line)
                per.append(len(numbers) - before)
            mask, sig, shingles, first = sign(raw)
            form = np.array(hashes, np.uint64).view(np.int64)
            line_at = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
            fresh, new, new_per = np.zeros(len(form), np.int32), [], []
            form_list, mask_list = form.tolist(), mask.tolist()
            if len(told) > 2_000_000:
                told.clear()
            for a, b in zip(line_at[:-1].tolist(), line_at[1:].tolist(), strict=True):
                seen, count = set(), 0
                for i in range(a, b):
                    f, m = form_list[i], mask_list[i]
                    if f not in seen:
                        seen.add(f)
                        fresh[i] = 1
                    if m not in told:
                        told.add(m)
                        new.append(i)
                        count += 1
                new_per.append(count)
            lines = pa.StructArray.from_arrays([pa.array(c) for c in (np.array(numbers, np.int32), form, mask, fresh, np.ascontiguousarray(sig[:, 0]), np.ascontiguousarray(sig[:, 1]))], names=["line_no", "form", "mask", "fresh", "s0", "s1"])
            sets = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(shingles)).take(pa.array(new, pa.int64()))
            masks = pa.StructArray.from_arrays([pa.array(mask[new]), sets], names=["mask", "shingles"])
            mask_at = pa.array(np.concatenate([[0], np.cumsum(new_per)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(line_at), lines), pa.ListArray.from_arrays(mask_at, masks)], names=[key, "lines", "masks"])

    return in_batches(df.select(key, text), run, f"`{key}` {df.schema[key].dataType.simpleString()}, lines array<struct<{_LINE}>>, masks array<struct<{_MASK}>>")


def source_of(path: Column) -> Column:
    """Host of a URL path without www. and port; repository before the colon; directory of a local path."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(path, r"(?i)^https?://(?:[^/?#]*@)?([^/?#]*)", 1)), r":\d*$", ""), r"^www\.", "")
    repo = F.regexp_extract(path, r"^([^/:\\]+/[^/:\\]+):", 1)
    folder = F.regexp_extract(path, r"(?s)^(.*)[/\\]", 1)
    return F.when(path.rlike("(?i)^https?://"), host).when(repo != "", repo).otherwise(folder)


def _agree(a: Column, b: Column) -> Column:
    """How many of the four min-hashes of two signature words agree."""
    x = a.bitwiseXOR(b)
    return sum((F.shiftrightunsigned(x, 16 * k).bitwiseAND(0xFFFF) == 0).cast("int") for k in range(4))


def clusters(forms_: DataFrame, shingles: DataFrame) -> DataFrame:
    """(form, cluster): the forms (form, source, mask, files, s0, s1) that are near copies of a lead, and that lead; others stand alone.  shingles: (mask, shingles), repeated rows or not."""
    hashes = [F.shiftrightunsigned(word, 16 * k).bitwiseAND(0xFFFF) for word in ("s0", "s1") for k in range(4)]
    alone, joined = forms_.select("form", "source", "files", "mask", "s0", "s1"), None
    for rows in BANDS:
        bands = F.array(*[F.xxhash64("source", F.lit(b), *[hashes[i] for i in picked]) for b, picked in enumerate(rows)])
        in_band = alone.select("form", "files", F.explode(bands).alias("band"))
        part = in_band.groupBy("band").agg(F.count("*").alias("m"), F.max(F.struct("files", "form")).alias("lead"))
        # a band of one form has no near copies; the engine sees the sizes of tables it has written, and picks its joins by them
        strong = stored(part.where("m > 1").select("band", "lead"))
        met = sieve(in_band, "band", strong).join(strong, "band").where(F.col("form") != F.col("lead.form"))
        met = stored(met.select("form", F.col("lead.files").alias("lead_files"), F.col("lead.form").alias("lead")).distinct())
        some = met.select("form").unionByName(met.select(F.col("lead").alias("form"))).distinct()
        some = stored(sieve(alone, "form", some).join(some, "form"))
        signed = some.select("form", "mask", "s0", "s1")
        close = met.join(signed, "form").join(signed.toDF("lead", "others", "t0", "t1"), "lead").where(_agree(F.col("s0"), F.col("t0")) + _agree(F.col("s1"), F.col("t1")) >= AGREE)
        close = stored(close.select("form", "mask", "lead", "lead_files", "others"))
        wanted = stored(close.select("mask").unionByName(close.select(F.col("others").alias("mask"))).distinct())
        sets = stored(sieve(shingles, "mask", wanted).join(wanted, "mask").dropDuplicates(["mask"]).select("mask", F.array_distinct("shingles").alias("shingles")))
        both = close.join(sets, "mask").join(sets.toDF("others", "theirs"), "others")
        shared = F.size(F.array_intersect("shingles", "theirs"))
        near = both.where(shared >= JACCARD * (F.size("shingles") + F.size("theirs") - shared))
        near = stored(near.groupBy("form").agg(F.max(F.struct("lead_files", "lead")).getField("lead").alias("cluster")))
        joined = near if joined is None else joined.unionByName(near)
        # who joined or was joined has its place; the others that met meet again in narrower bands
        if rows is not BANDS[-1]:
            placed = near.select("form").unionByName(near.select(F.col("cluster").alias("form"))).distinct()
            alone = stored(some.join(placed, "form", "left_anti"))
    # a lead of one band may be a follower in another
    while True:
        up = joined.select(F.col("form").alias("cluster"), F.col("cluster").alias("_up"))
        higher = stored(joined.join(up, "cluster", "left").select("form", F.coalesce("_up", "cluster").alias("cluster"), F.col("_up").isNotNull().alias("moved")))
        joined = higher.select("form", "cluster")
        if higher.where("moved").isEmpty():
            return joined


def repeated_lines(texts: DataFrame, sources: DataFrame, key: str = "file_id", text: str = "text", min_files: int = MIN_FILES) -> DataFrame:
    """The lines of frequent clusters in texts (key, text) whose source is given by sources (key, source).

    One row per line: key, line_no, form (hash of source and form), form_files (files with
    this very form), cluster (the form it is a near copy of).  The clusters stand in at least ``min_files`` files.
    """
    one = sources.groupBy(key).agg(F.min("source").alias("source")).where("source is not null")
    raw = stored(file_lines(texts, key, text).where(F.size("lines") > 0))
    read = stored(raw.select(key, "lines").dropDuplicates([key]).join(one, key).select(key, F.xxhash64("source").alias("source"), "lines"))
    lines = read.select(key, "source", F.explode("lines").alias("_l")).select(key, "source", F.xxhash64("source", "_l.form").alias("form"), "_l.line_no", "_l.mask", "_l.fresh", "_l.s0", "_l.s1")
    # a form in several spellings may have several masks: the least one holds
    counted = lines.groupBy("form").agg(F.sum("fresh").cast("int").alias("files"), F.min("source").alias("source"), F.min(F.struct("mask", "s0", "s1")).alias("_m"))
    counted = stored(counted.select("form", "files", "source", "_m.*"))
    near = clusters(counted, raw.select(F.explode("masks").alias("_m")).select("_m.*"))
    member = near.unionByName(near.select(F.col("cluster").alias("form"), "cluster").distinct()).join(counted.select("form", "files"), "form")
    sums = member.groupBy("cluster").agg(F.max("files").alias("most"), F.sum("files").alias("sum"))
    member = stored(member.join(sums, "cluster"))
    # a form alone is frequent or not by its own files, as is a cluster with such a form in it
    sure = counted.where(F.col("files") >= min_files).select("form", "files").join(member.select("form"), "form", "left_anti").withColumn("cluster", F.col("form"))
    sure = sure.unionByName(member.where(F.col("most") >= min_files).select("form", "files", "cluster"))
    # otherwise files with several forms of the cluster count once
    unsure = member.where((F.col("most") < min_files) & (F.col("sum") >= min_files)).select("form", "files", "cluster")
    enough = sieve(lines.where("fresh = 1").select(key, "form"), "form", unsure).join(unsure, "form").groupBy("cluster").agg(F.count_distinct(key).alias("n")).where(F.col("n") >= min_files)
    bad = stored(sure.unionByName(unsure.join(enough.select("cluster"), "cluster", "left_semi").select("form", "files", "cluster")))
    salted = bad.select("form", F.col("files").alias("form_files"), "cluster", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return sieve(lines.select(key, "line_no", "form"), "form", bad).select(key, "line_no", "form", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("_salt")).join(salted, ["form", "_salt"]).drop("_salt")


def without_lines(texts: DataFrame, bad: DataFrame, key: str = "file_id", text: str = "text") -> DataFrame:
    """The texts without the lines (key, line_no) of ``bad``; other columns stay."""
    numbers = bad.groupBy(key).agg(F.collect_set("line_no").alias("_bad"))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.coalesce(F.array_contains("_bad", i + 1), F.lit(False))), "\n")
    return texts.join(numbers, key, "left").withColumn(text, F.when(F.col("_bad").isNull(), F.col(text)).otherwise(kept)).drop("_bad")
