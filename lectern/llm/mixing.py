"""Problem 8: mix sources to target shares of the total size.

Method: Pfair scheduling.  The size to mix (``total``, by default the tokens of
the whole table) is cut into a fixed number of slots of one block each.  Source
i with share w is a periodic task: its block j may run from slot floor(j / w)
(release) and must have run by ceil((j + 1) / w) (deadline).  Earliest deadline
first over these windows gives an order of blocks in which, at any point, every
source is less than one block off its share.  Blocks that hold part of a source's quota
but have a later deadline than the last slot (of shares about a block or less) get slots behind
it, so the schedule has about ``slots`` rows and three a target, whatever the size of the corpus, and
a document without a slot is an error; documents find their place in it by their
position within their source.

That position is a running sum in a fixed pseudo-random order (hash of the key),
computed in two levels: totals of ``2 ** bits`` hash ranges per source, their number
growing with the documents, then a window within one range.  No task ever holds
a whole source.

Results: a source with too few tokens is used ``max_repeats`` times in full and
then ends (its slots stay empty, the other shares are not blown up); a document
is used if the larger part of it lies before the source's quota, so quotas hold
to half a document.  Documents of null or unlisted source are not in the mix;
documents without tokens have their place in it like any other; a source
of the targets without documents is reported with share 0.  Repeated target rows
count once.  Shares must be at least 0 and are scaled to sum 1; null or negative
ones raise ValueError, as do sources listed twice with different values.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Blocks in the whole mix; the size of the schedule, whatever the corpus.
SLOTS = 4096
#: log2 of the hash ranges per source, at least and at most; in between there are about 65,000 documents to a range.
RANGE_BITS, MOST_BITS = 10, 20


def pfair_schedule(weights: dict[str, float], slots: int, blocks: dict[str, int] | None = None) -> list[tuple[int, str, int]]:
    """(slot, source, block number of that source), earliest deadline first among released blocks.

    ``blocks`` says how many blocks of each source are to be placed; those that didn't come within ``slots`` get slots behind them.
    """
    blocks = {s: n for s, n in (blocks or {}).items() if weights[s] > 0}
    left = sum(blocks.values())
    waiting: list[tuple[int, str, int]] = []  # by release
    ready: list[tuple[int, int, str, int]] = []  # by deadline, then release, then name

    def window(source: str, j: int) -> tuple[int, int]:
        w = weights[source]
        return math.floor(j / w + 1e-9), math.ceil((j + 1) / w - 1e-9)

    for source in sorted(weights):
        if weights[source] > 0:
            heapq.heappush(waiting, (0, source, 0))
    out = []
    slot = 0
    while slot < slots or left > 0:
        while waiting and waiting[0][0] <= slot:
            release, source, j = heapq.heappop(waiting)
            heapq.heappush(ready, (window(source, j)[1], release, source, j))
        if not ready:
            if not waiting:
                break
            slot = waiting[0][0]  # nothing is released before
            continue
        _, _, source, j = heapq.heappop(ready)
        if slot >= slots and j >= blocks.get(source, 0):
            continue  # this source has all its blocks
        out.append((slot, source, j))
        left -= j < blocks.get(source, 0)
        heapq.heappush(waiting, (max(slot + 1, window(source, j + 1)[0]), source, j + 1))
        slot += 1
    return out


def target_table(targets: DataFrame, limit: int = 100_000) -> list[tuple[str, float, int]]:
    """The targets on the driver: one row per source, at most ``limit``."""
    rows = targets.select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).distinct().orderBy("source").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} targets")
    if any(r[0] is None or r[1] is None or r[2] is None or not r[1] >= 0 or r[2] < 0 for r in rows):
        raise ValueError("a target needs a source, a share of at least 0 and a number of repeats")
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("a source has two targets")
    whole = sum(r[1] for r in rows) or 1.0
    return [(r[0], r[1] / whole, r[2]) for r in rows]


def positions(sized: DataFrame, key: str = "doc_id", bits: int = RANGE_BITS) -> DataFrame:
    """Adds start (tokens before the document in its source) and supply (tokens of its source)."""
    placed = sized.withColumn("_h", F.xxhash64(key)).withColumn("_range", F.shiftrightunsigned("_h", 64 - bits))
    totals = placed.groupBy("source", "_range").agg(F.sum("n_tokens").alias("_n"))
    # at most 2 ** bits rows a source here, however many documents it has
    before = W.partitionBy("source").orderBy("_range")
    totals = totals.select(
        "source", "_range",
        (F.sum("_n").over(before) - F.col("_n")).alias("_before"),
        F.sum("_n").over(W.partitionBy("source")).alias("supply"),
    )
    within = W.partitionBy("source", "_range").orderBy("_h", key)
    running = placed.withColumn("_within", F.sum("n_tokens").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens"))
    return running.join(totals, ["source", "_range"]).withColumn("start", F.col("_before") + F.col("_within")).drop("_h", "_range", "_before", "_within")


def mix(sized: DataFrame, targets: DataFrame, total: int | None = None, slots: int = SLOTS, key: str = "doc_id", bits: int | None = None) -> DataFrame:
    """One row per use of a document: slot, source, block, copy, key, n_tokens, offset (within the source's share).

    ``sized`` has key, source and n_tokens.  Read the rows by (slot, offset) for the mix.
    """
    spark = sized.sparkSession
    goal = target_table(targets)
    tokens, documents = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    total = tokens if total is None else total
    if bits is None:
        bits = min(MOST_BITS, max(RANGE_BITS, (documents >> 16).bit_length()))
    size = max(1, math.ceil(total / slots))
    plan = spark.createDataFrame([(s, share, share * total, n) for s, share, n in goal if share > 0], "source string, share double, quota double, max_repeats int")
    listed = sized.select(F.col(key), "source", "n_tokens").join(F.broadcast(plan), "source")
    middle = F.col("start") + F.col("n_tokens") / 2
    # copy k begins at k * supply; it is used while its middle lies before the quota
    copies = F.when(F.col("supply") == 0, F.least(F.lit(1), F.col("max_repeats"))).otherwise(
        F.least(F.col("max_repeats"), F.greatest(F.lit(0), F.ceil((F.col("quota") - middle) / F.col("supply")))).cast("int")
    )
    used = (
        positions(listed, key, bits)
        .withColumn("_copies", copies)
        .where("_copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
        .withColumn("offset", F.col("copy") * F.col("supply") + F.col("start"))
        .withColumn("block", F.floor(F.col("offset") / F.lit(size)))
    )
    blocks = {s: math.floor(w * total / size) + 1 for s, w, _ in goal}
    schedule = spark.createDataFrame(pfair_schedule({s: w for s, w, _ in goal}, slots + 2 * len(goal), blocks), "slot int, source string, block bigint")
    lost = F.raise_error(F.concat(F.lit("no slot for a block of "), "source")).cast("int")
    return used.join(F.broadcast(schedule), ["source", "block"], "left").select(F.coalesce("slot", lost).alias("slot"), "source", "block", "copy", key, "n_tokens", "offset")


def shares(mixed: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: target_share, actual_share (of what was mixed), tokens, documents, most_uses of one document."""
    key = next(c for c in mixed.columns if c not in {"slot", "source", "block", "copy", "n_tokens", "offset"})
    own = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count_distinct(key).alias("documents"), (F.max("copy") + 1).alias("most_uses"))
    goal = mixed.sparkSession.createDataFrame(target_table(targets), "source string, target_share double, max_repeats int")
    joined = goal.join(own, "source", "left").fillna(0, ["tokens", "documents", "most_uses"])
    return joined.select(
        "source", "target_share", "max_repeats", "tokens", "documents", F.col("most_uses").cast("int").alias("most_uses"),
        F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(W.partitionBy(F.lit(0)))), F.lit(0.0)).alias("actual_share"),
    )

