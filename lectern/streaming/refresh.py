"""Keeping a snapshot up to date from documents as they arrive.

A stream of documents has its facts computed batch by batch; what is new or
has another hash than the snapshot goes into the next version of it.  Versions
are folders of Parquet in the shared store, written once each under the batch's
number, so a batch that is run again after a failure writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.report import doc_facts
from lectern.operators.snapshots import changes


def _version(spark: SparkSession, folder: str, n: int) -> DataFrame | None:
    path = f"{folder}/v={n}"
    store = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = store.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS"))
    return spark.read.parquet(path) if there else None


def refresh_stream(documents: DataFrame, folder: str, checkpoint: str, key: str = "key", text: str = "text", at: str = "fetched_at", late: str = "30 days") -> StreamingQuery:
    """Runs until all that has arrived is in the snapshot; returns the finished query.

    ``documents`` is a streaming frame with key, text and a time.  Exact repeats
    of a document within the watermark are dropped before they cost anything.
    Each version holds (key, content_hash, estimated_tokens, at), and changes/v=n what moved in it.
    """
    spark = documents.sparkSession
    fresh = documents.withColumn("_h", F.xxhash64(text)).withWatermark(at, late).dropDuplicatesWithinWatermark([key, "_h"]).drop("_h")

    def merge(batch: DataFrame, n: int) -> None:
        facts = doc_facts(batch.select(key, text, at), key, text)
        newest = facts.groupBy(key).agg(F.max_by(F.struct("content_hash", "estimated_tokens"), F.struct(at, "content_hash")).alias("v"), F.max(at).alias("at"))
        now = newest.select(F.col(key).alias("key"), "v.content_hash", "v.estimated_tokens", "at")
        before = _version(spark, folder, n - 1)
        if before is None:
            now.write.mode("overwrite").parquet(f"{folder}/v={n}")
            return
        ahead = before.alias("b").join(now.alias("n"), "key", "full_outer")
        later = F.col("n.at").isNotNull() & (F.col("b.at").isNull() | (F.col("n.at") >= F.col("b.at")))
        merged = ahead.select("key", *[F.when(later, F.col(f"n.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in ("content_hash", "estimated_tokens", "at")])
        merged.write.mode("overwrite").parquet(f"{folder}/v={n}")
        changes(before.select("key", "content_hash"), spark.read.parquet(f"{folder}/v={n}").select("key", "content_hash")).write.mode("overwrite").parquet(f"{folder}/changes/v={n}")

    query = fresh.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
