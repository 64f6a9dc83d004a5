"""What moved between two readings of the same sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHOWN = 20


def identity(origin: Column, label: Column) -> Column:
    """A document's key: where it came from and what it is called there, so that files of one repository stay apart."""
    return F.when(origin.isNull() | (origin == label), label).otherwise(F.concat(origin, F.lit(" "), label))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, change) between two sets of (key, content_hash): added, removed, changed; keys are taken to be distinct, null hashes compare as equal."""
    b, a = before.select("key", F.col("content_hash").alias("was"), F.lit(True).alias("_b")), after.select("key", F.col("content_hash").alias("now"), F.lit(True).alias("_a"))
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return b.join(a, "key", "full_outer").select("key", kind.alias("change")).where("change is not null")


def summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """(was_tokens, now_tokens, added, removed, changed, moved), one row; the sets also carry estimated_tokens."""
    counts = changes(before, after).agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")])
    was = before.agg(F.coalesce(F.sum("estimated_tokens"), F.lit(0)).alias("was_tokens"))
    now = after.agg(F.coalesce(F.sum("estimated_tokens"), F.lit(0)).alias("now_tokens"))
    # three single rows
    joined = was.join(now, F.lit(True)).join(counts, F.lit(True))
    return joined.withColumn("moved", F.col("added") + F.col("removed") + F.col("changed") > 0)


def shown(moved: DataFrame, most: int = SHOWN) -> DataFrame:
    """(change, place, key): the first keys of each kind, and a last row that counts those left out."""
    ranked = moved.withColumn("place", F.row_number().over(W.partitionBy("change").orderBy("key")))
    head = ranked.where(F.col("place") <= most).select("change", F.col("place").cast("bigint").alias("place"), "key")
    left = moved.groupBy("change").agg((F.count("*") - most).alias("n")).where("n > 0")
    return head.unionByName(left.select("change", F.lit(most + 1).cast("bigint").alias("place"), F.concat(F.lit("... and "), F.col("n").cast("string"), F.lit(" more")).alias("key")))


def changelog(entry: str, existing: str) -> str:
    """A new entry on top, the header once."""
    header = "# Changelog\n"
    return f"{header}\n{entry.strip()}\n{existing.removeprefix(header)}"
