"""The facts of each document read, and the report of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.sources import read_outcome


def doc_facts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The documents with content_hash, characters, estimated_tokens and invisible_codepoints_removed, all of the text without invisible code points.

    Null text counts as empty.  Columns of these names are replaced.
    """
    facts = docs.withColumn("_clean", T.sanitize(F.coalesce(text, F.lit(""))))
    facts = facts.withColumn("invisible_codepoints_removed", (F.char_length(F.coalesce(text, F.lit(""))) - F.char_length("_clean")).cast("bigint"))
    return facts.withColumns({"content_hash": T.fingerprint("_clean"), "characters": F.char_length("_clean").cast("bigint"), "estimated_tokens": T.estimate_tokens(F.col("_clean"))}).drop("_clean")


def run_report(docs: DataFrame, source: str, path: str, text: str = "text", ocr: str = "pages_needing_ocr") -> DataFrame:
    """One row per source: documents, characters, estimated_tokens, failures, visual (documents with pages to look at)."""
    outcome = read_outcome(F.col(text), F.col(ocr))
    rows = docs.select(F.col(source).alias("source"), outcome.alias("o"), F.col(text).alias("t"), F.col(path).alias("p"), (F.coalesce(F.size(ocr), F.lit(0)) > 0).alias("look"))
    rows = rows.withColumn("t", F.when(F.col("o") == "read", T.sanitize(F.col("t"))))
    rows = rows.select("source", "o", "p", "look", F.char_length("t").alias("n"), T.estimate_tokens(F.col("t")).alias("k"))
    # exact copies of a row count once; what is compared are facts, not texts
    rows = rows.dropDuplicates(["source", "p"])
    return rows.groupBy("source").agg(
        F.count_if(F.col("o") != "failed").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("characters"), F.coalesce(F.sum("k"), F.lit(0)).alias("estimated_tokens"),
        F.count_if(F.col("o") == "failed").alias("failures"), F.count_if("look").alias("visual"),
    )


def visual_requests(docs: DataFrame, path: str, pages: str = "pages_needing_ocr") -> DataFrame:
    """(path, pages): what has to be looked at, because it has no text to read."""
    return docs.where(F.coalesce(F.size(pages), F.lit(0)) > 0).select(F.col(path).alias("path"), F.array_join(pages, ",").alias("pages")).distinct()


def as_json(report: DataFrame, key: str = "source") -> DataFrame:
    """(key, report) as one JSON object per row."""
    return report.select(key, F.to_json(F.struct(*report.columns)).alias("report"))
