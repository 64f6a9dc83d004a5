"""Problem 6: all pairs of records whose sets of values are similar.

Method: pigeonhole partitioning.  The universe of tokens is split into segments
whose number grows with the length of the sets, so that a pair that is similar
enough must share ``PICK`` tokens of one segment; what a record has in a segment
gives signatures by deletion down to so many tokens, two records meet where they
have a signature in common, and candidates are verified exactly.

Why no pair is lost.  Let o be the shared tokens a pair must have (from the
threshold, its lengths and ``least_shared``) and all tokens be in one order.  Of
a set of n tokens the last o - L can be left out: the first L shared tokens
come before them in both sets.  L tokens over L - 1 segments leave two to one of them
(L is the least o of the length group; where that is 1, single tokens are the signatures).

Buckets.  The most frequent tokens come last in the order, so they are what is
left out.  A signature that more than ``HEAVY`` records have is not joined: its records are
dealt out by the lengths of both sets and the first of their other tokens, one of which
the pair must share as well, and so on while a bucket is heavy.  Once as many tokens
are picked as the two lengths call for, whoever meets is a link.  Where dealing a bucket out
wouldn't halve its pairs, its records are alike in the rarest tokens they have, so most of its pairs are near to links,
and it is joined as it is.  So work grows with the records and the links, not with the
square of how many share some words.  What is joined has a bitmap of its tokens (one bit each,
by parity), whose differing bits bound the differing tokens from below; it rules out
most candidates before their sets are fetched.

Length groups are [2^g, 2^(g+1)); a pair is sought in the group of its longer set, where
the shorter one looks it up.  Records with the same set are one class, compared once.
Only the order depends on how frequent tokens are, never the result: it knows the ``RANKED`` most
frequent ones, a bound that doesn't grow with the data; the others come before them by their hash.

Results: null, empty and too small sets are in no pair; null values don't count; repeated values
in a set count once, as do repeated rows of a record.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.sources.tables import in_batches, stored

#: Tokens whose place in the order is by their frequency.
RANKED = 20_000
#: Records with one signature beyond which its bucket is dealt out further, if that leaves less than this share of its pairs.
HEAVY, WORTH = 512, 0.5
#: Lengths up to this one are told apart where a bucket is dealt out, longer ones in steps of a sixteenth.
EXACT_LENGTHS = 32


class Signatures:
    """Signatures of arrays of 64-bit token hashes; ranks of frequent tokens, the most frequent one last."""

    def __init__(self, ranks: dict[int, int], threshold: float, least: int) -> None:
        self.ranks, self.threshold, self.least = ranks, threshold, least
        self.leasts: dict[int, int] = {}
        self.ways: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def need(self, n: int, m: int) -> int:
        """Tokens that sets of these lengths must share."""
        return max(self.least, 1, math.ceil(self.threshold / (1 + self.threshold) * (n + m) - 1e-9))

    def ordered(self, tokens: list[int]) -> list[int]:
        rank = self.ranks.get
        return sorted(tokens, key=lambda x: (rank(x, 0), x))

    def groups(self, n: int) -> range:
        """The groups of the longer sets that a set of n tokens may match; the first is its own."""
        return range(n.bit_length() - 1, int(n / self.threshold + 1e-9).bit_length())

    def group_least(self, group: int) -> int:
        """The least that a pair of the group must share."""
        if group not in self.leasts:
            longer = 1 << group
            self.leasts[group] = self.need(longer, math.ceil(self.threshold * longer - 1e-9))
        return self.leasts[group]

    def of(self, ordered: list[int]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(signature, 1 if the set is of the group's own lengths, the tokens picked)"""
        n = len(ordered)
        for k, group in enumerate(self.groups(n)):
            share = self.group_least(group)
            # the least of any partner in this group: as the longer set in its own, as the shorter one elsewhere
            least = self.need(n, math.ceil(self.threshold * n - 1e-9)) if k == 0 else self.need(n, 1 << group)
            if least > n:
                continue
            prefix = ordered[: n - least + share]
            if share == 1:
                for x in prefix:
                    yield hash((group, x)), int(k == 0), (x,)
                continue
            segments = share - 1
            parts: dict[int, list[int]] = {}
            for x in prefix:
                parts.setdefault((x >> 7) % segments, []).append(x)
            for part in parts.values():
                for pair in combinations(part, 2):
                    yield hash((group, *pair)), int(k == 0), pair

    @staticmethod
    def length_class(n: int) -> int:
        """The least length of a length's class."""
        step = 1 if n <= EXACT_LENGTHS else 1 << (n.bit_length() - 5)
        return n // step * step

    def partners(self, n: int, own: int) -> list[tuple[int, int]]:
        """(class of the partner's length, tokens to share): all that its own group has for it, else longer ones."""
        if (n, own) in self.ways:
            return self.ways[n, own]
        most = int(n / self.threshold + 1e-9)
        lengths = range(math.ceil(self.threshold * n - 1e-9), min(most, (1 << n.bit_length()) - 1) + 1) if own else range(1 << n.bit_length(), most + 1)
        mine = self.length_class(n)
        self.ways[n, own] = [(c, self.need(mine, c)) for c in dict.fromkeys(map(self.length_class, lengths))]
        return self.ways[n, own]

    def deal(self, ordered: list[int], sig: int, own: int, picked: tuple[int, ...], partner: int, share: int) -> Iterator[tuple[int, tuple[int, ...], int, int]]:
        """(signature, tokens picked, partner's length class, tokens to share) of a record in a heavy bucket."""
        n = len(ordered)
        mine = self.length_class(n)
        ways = [(partner, share)] if partner else self.partners(n, own)
        for other, s in ways:
            key = (sig, -1) if partner else (sig, min(mine, other), max(mine, other))
            if s <= len(picked):
                yield hash(key), picked, other, s
                continue
            rest = [x for x in ordered if x not in picked]
            for x in rest[: max(0, n - s + 1)]:
                yield hash((*key, x)), (*picked, x), other, s


_ROW = "class {id}, side int, n int, bits bigint, sig bigint, own int, picked array<bigint>, partner int, share int, parent bigint"


def _bits(tokens: list[int]) -> int:
    out = 0
    for x in tokens:
        out ^= 1 << ((x >> 13) & 63)
    return out - (1 << 64) if out >> 63 else out


def _required(n: Column, m: Column, threshold: float, least: int) -> Column:
    return F.greatest(F.lit(max(least, 1)), F.ceil(F.lit(threshold / (1 + threshold)) * (n + m) - 1e-9)).cast("int")


def _signed(sets: DataFrame, make: Signatures, id_type: str) -> DataFrame:
    """The signatures of sets (class, side, h, and for records of heavy buckets sig, own, picked, partner, share)."""
    heavy = "sig" in sets.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(9)]

            def out(batch=batch, rows=rows) -> pa.RecordBatch:
                at = pa.array(rows[0], pa.int64())
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int64()]
                made = [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(r, k) for r, k in zip(rows[1:], kinds, strict=True))]
                for r in rows:
                    r.clear()
                return pa.RecordBatch.from_arrays(made, names=["class", "side", "n", "bits", "sig", "own", "picked", "partner", "share", "parent"])

            columns = [c.to_pylist() for c in batch.columns[2:]]
            before, firsts = None, {}
            for i, (tokens, *more) in enumerate(zip(*columns, strict=True)):
                if tokens != before:
                    before, firsts, ordered, bits = tokens, {}, make.ordered(tokens), _bits(tokens)
                if not heavy:
                    for sig, own, _ in make.of(ordered):
                        for r, v in zip(rows, (i, len(ordered), bits, sig, own, None, 0, 0, None), strict=True):
                            r.append(v)
                else:
                    sig, own, picked, partner, share = more
                    # of the first signatures the tokens aren't kept: they are those with this signature
                    if not picked and not firsts:
                        for s, _, p in make.of(ordered):
                            firsts.setdefault(s, set()).add(p)
                    ways = [tuple(picked)] if picked else firsts[sig]
                    for way in ways:
                        for s, p, other, least in make.deal(ordered, sig, own, way, partner, share):
                            for r, v in zip(rows, (i, len(ordered), bits, s, own, list(p), other, least, sig), strict=True):
                                r.append(v)
                if len(rows[0]) > 50_000:
                    yield out()
            yield out()

    return in_batches(sets, run, _ROW.format(id=id_type))


def candidates(grouped: DataFrame, threshold: float, least_shared: int, ranks: dict[int, int], two: bool) -> DataFrame:
    """(ca, sa, cb, sb): the pairs of classes (class, side, h) that meet and whose bitmaps leave it open that they are similar, once each."""
    make = Signatures(ranks, threshold, least_shared)
    id_type = grouped.schema["class"].dataType.simpleString()
    sets = grouped.select("class", "side", "h")
    level, found = stored(_signed(sets, make, id_type)), []
    while True:
        # buckets whose records have picked as many tokens as they must share hold links only
        counts = level.where("share = 0 or share > size(picked)").groupBy("sig").agg(F.count("*").alias("_n"))
        heavy = stored(counts.where(F.col("_n") > HEAVY))
        if heavy.isEmpty():
            break
        crowded = level.join(heavy.select("sig"), "sig", "left_semi").select("class", "side", "sig", "own", "picked", "partner", "share")
        dealt = stored(_signed(crowded.join(sets, ["class", "side"]).select("class", "side", "h", "sig", "own", "picked", "partner", "share"), make, id_type))
        left = dealt.groupBy("parent", "sig").agg(F.count("*").cast("double").alias("_c")).groupBy("parent").agg(F.sum(F.col("_c") * F.col("_c")).alias("_c"))
        worth = stored(heavy.join(left, heavy["sig"] == left["parent"]).where(F.col("_c") < WORTH * F.col("_n") * F.col("_n")).select("sig"))
        found.append(_met(level.join(worth, "sig", "left_anti"), threshold, least_shared, two))
        level = dealt.join(worth.select(F.col("sig").alias("parent")), "parent", "left_semi")
        level = stored(level)
    found.append(_met(level, threshold, least_shared, two))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def _met(level: DataFrame, threshold: float, least_shared: int, two: bool) -> DataFrame:
    rows = level.select("class", "side", "n", "bits", "sig", "own")
    a, b = rows.alias("a"), rows.where("own = 1").alias("b")
    # each pair once: b is the longer set, or of the same length the later one
    first = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & ((F.col("a.class") < F.col("b.class")) | (F.col("a.side") < F.col("b.side"))))
    first = first & (F.col("a.side") != F.col("b.side") if two else F.col("a.side") == F.col("b.side"))
    within = F.col("a.n") >= F.lit(threshold - 1e-9) * F.col("b.n")
    apart = F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits"))) <= F.col("a.n") + F.col("b.n") - 2 * _required(F.col("a.n"), F.col("b.n"), threshold, least_shared)
    met = a.join(b, (F.col("a.sig") == F.col("b.sig")) & first & within & apart)
    return met.select(F.col("a.class").alias("ca"), F.col("a.side").alias("sa"), F.col("b.class").alias("cb"), F.col("b.side").alias("sb"))


def similar_pairs(sets: DataFrame, threshold: float, least_shared: int = 1, least_size: int = 1, other: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, classes) of sets (id, terms), or between sets and ``other``.

    classes: id, side, class (the least id of the side's records with that set).  links: class_a, class_b,
    shared, overlap; within one table class_a <= class_b, and a class of several records is linked with itself.
    """
    two = other is not None
    sides = sets.select("id", "terms", F.lit(0).alias("side"))
    if two:
        sides = sides.unionByName(other.select("id", "terms", F.lit(1).alias("side")))
    hashed = sides.select("id", "side", F.array_sort(F.array_distinct(F.transform(F.filter("terms", lambda x: x.isNotNull()), lambda x: F.xxhash64(x)))).alias("h"))
    members = stored(hashed.where(F.size("h") >= max(1, least_size)).dropDuplicates(["side", "id"]))
    grouped = stored(members.groupBy("side", "h").agg(F.min("id").alias("class"), F.count("*").alias("records")))
    frequent = grouped.select(F.explode("h").alias("x")).groupBy("x").count().orderBy(F.desc("count"), "x").limit(RANKED).collect()
    ranks = {r[0]: i for i, r in enumerate(reversed(frequent), 1)}
    pairs = candidates(grouped, threshold, least_shared, ranks, two)
    # exact: the sets of what is left
    side = grouped.select("class", "side", "h")
    x = side.select(F.col("class").alias("ca"), F.col("side").alias("sa"), F.col("h").alias("ha"))
    y = side.select(F.col("class").alias("cb"), F.col("side").alias("sb"), F.col("h").alias("hb"))
    shared = F.size(F.array_intersect("ha", "hb"))
    sized = pairs.join(x, ["ca", "sa"]).join(y, ["cb", "sb"]).select("ca", "sa", "cb", "sb", shared.alias("shared"), (F.size("ha") + F.size("hb")).alias("both"))
    overlap = F.col("shared") / (F.col("both") - F.col("shared"))
    good = sized.where((F.col("shared") >= least_shared) & (overlap >= threshold))
    turn = F.col("sa") > F.col("sb") if two else F.col("ca") > F.col("cb")
    links = good.select(F.when(turn, F.col("cb")).otherwise(F.col("ca")).alias("class_a"), F.when(turn, F.col("ca")).otherwise(F.col("cb")).alias("class_b"), "shared", overlap.alias("overlap"))
    if two:
        left, right = grouped.where("side = 0").alias("l"), grouped.where("side = 1").alias("r")
        same = left.join(right, F.col("l.h") == F.col("r.h")).where(F.size("l.h") >= least_shared).select(F.col("l.class").alias("class_a"), F.col("r.class").alias("class_b"), F.size("l.h").alias("shared"), F.lit(1.0).alias("overlap"))
        links = links.where("overlap < 1")
    else:
        same = grouped.where((F.col("records") > 1) & (F.size("h") >= least_shared)).select(F.col("class").alias("class_a"), F.col("class").alias("class_b"), F.size("h").alias("shared"), F.lit(1.0).alias("overlap"))
    classes = members.join(grouped.select("side", "h", "class"), ["side", "h"]).select("id", "side", "class")
    return links.unionByName(same), classes


def expand(links: DataFrame, classes: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the pairs of records behind links within one table."""
    a = classes.select(F.col("class").alias("class_a"), F.col("id").alias("x"))
    b = classes.select(F.col("class").alias("class_b"), F.col("id").alias("y"))
    pairs = links.select("class_a", "class_b").join(a, "class_a").join(b, "class_b")
    pairs = pairs.where((F.col("class_a") != F.col("class_b")) | (F.col("x") < F.col("y")))
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
