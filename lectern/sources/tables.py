"""Reading the project's tables, and the shared folder for cut lineage."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of all executors, once per application."""
    context = spark.sparkContext
    if getattr(context, "_lectern_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("lectern", os.path.relpath(full, root)))
    # read once by the driver, which serves it to the executors itself
    path = os.path.join(tempfile.mkdtemp(prefix="lectern-"), "lectern.zip")
    with open(path, "wb") as f:
        f.write(packed.getvalue())
    context.addPyFile(path)
    context._lectern_shipped = True


#: A scan of so few splits is dealt out to all cores before Python sees it: what that moves is bounded by these splits.
HANDFUL = 4
#: What a plan may consist of for its splits to be those of its scan.
_NARROW = frozenset("Project Filter LogicalRelation Relation Generate".split())


def spread(df: DataFrame) -> DataFrame:
    """The rows of a handful of splits over all cores; anything larger, and what isn't just read, stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if cores <= HANDFUL:
        return df
    nodes = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    if not all(re.sub(r"^[\s:+-]*", "", n).split(" ")[0].split("[")[0] in _NARROW for n in nodes if n.strip()):
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() <= HANDFUL else df


def in_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over the Arrow batches of the rows, with this package at hand; where the rows are, but for scans of a handful of splits."""
    ship(df.sparkSession)
    return spread(df).mapInArrow(run, schema)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``, and one of our own only where everything runs on this machine.

    Raises ValueError on a cluster without that setting: a folder of one machine would lose rows.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(context, "_lectern_folder"):
        context._lectern_folder = tempfile.mkdtemp(prefix="lectern-")
    return context._lectern_folder


def checkpoint(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    spark = spark or df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row per key where repeated rows are exact copies."""
    return df.dropDuplicates([key])


#: Bits of the bitmaps that tell which rows can be left out before a shuffle; as words of 64 a broadcast of 16 MB at most.
SIEVE = 1 << 25


def _marked(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    place = F.pmod(F.xxhash64(F.lit("sieve"), key), F.lit(SIEVE))
    bits = wanted.select(place.alias("_p")).groupBy(F.shiftright("_p", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_p & 63 as int))")).alias("_bits"))
    return df.withColumn("_p", place).withColumn("_word", F.shiftright("_p", 6)).join(F.broadcast(bits), "_word", "left").withColumn("_maybe", F.coalesce(F.expr("shiftright(_bits, cast(_p & 63 as int)) & 1 = 1"), F.lit(False)))


def sieve(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key may be one of ``wanted``'s, and none lost: what a join with ``wanted`` needs, without shuffling the rest."""
    return _marked(df, key, wanted).where("_maybe").select(*df.columns)


def one_per_key_in_place(df: DataFrame, key: str) -> DataFrame:
    """``one_per_key`` for wide rows: only keys are counted, and only rows whose key may be there twice are shuffled.  A null key counts as a key."""
    twice = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    marked = _marked(df, key, stored(twice))
    return marked.where("not _maybe").select(*df.columns).unionByName(marked.where("_maybe").select(*df.columns).dropDuplicates([key]))


def numbered(df: DataFrame, group: list[str], key: str, name: str, shift: int = 12) -> DataFrame:
    """Numbers the rows of each group from 1 in the order of an integer key, without a task ever holding a whole group.

    Ranges of ``2 ** shift`` keys are counted first; a row's number is what its
    group has in the ranges before, and its place in its own range.  Only one row per group and
    range is in the window over the ranges.
    """
    ranged = df.withColumn("_range", F.shiftright(F.col(key), shift))
    counts = ranged.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*group).orderBy("_range")
    counts = counts.select(*group, "_range", (F.sum("_n").over(before) - F.col("_n")).alias("_before"))
    own = F.row_number().over(W.partitionBy(*group, "_range").orderBy(key))
    placed = ranged.withColumn("_own", own).join(counts, [*group, "_range"])
    return placed.withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_before", "_own")


def latest(df: DataFrame, key: str, by: str) -> DataFrame:
    """The row of each key that came last; ties by the whole row, nulls first."""
    order = [F.col(by).desc_nulls_last(), F.xxhash64(*df.columns)]
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def stored(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """The frame written once as a table in the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = spark or df.sparkSession
    path = f"{shared_folder(spark)}/lectern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # gone when the application ends
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, key: str, most: int) -> list:
    """At most ``most`` rows on the driver, those of the least key hashes, one per key: the same rows whatever the partitioning.

    Two passes: a count, then a filter on the hash that lets about 1.3 * ``most`` rows through, so no task sends more than its share.
    """
    n = df.count()
    bits = 24
    least = (1 << bits) if n <= most else min(1 << bits, int((1 << bits) * (1.3 * most + 50) / n) + 1)
    placed = df.withColumn("_h", F.xxhash64(F.lit("sample"), key))
    kept = placed.where(F.shiftrightunsigned("_h", 64 - bits) < least).orderBy(F.shiftrightunsigned("_h", 1), key).limit(3 * most + 100).collect()
    out = {}
    for r in kept:
        out.setdefault(r[key], r)
    return [*out.values()][:most]
