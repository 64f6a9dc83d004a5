"""Queries p1_ to p9_, over the whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.terms import distinctive_terms
from lectern.functions.text import WS
from lectern.llm import fetched, lines, markup, mixing, pairs, pii, splitting, tokenize
from lectern.plans import skills as skill_plans
from lectern.sources.tables import one_per_key, one_per_key_in_place, stored, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The languages whose syntax stands in a file's text."""
    found = markup.decoded(table(spark, d, "extractions"))
    return found.select("file_id", F.explode("markup").alias("markup")).distinct()


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """The texts without markup residue; headings, lists, code and formulas stay."""
    return markup.decoded(one_per_key_in_place(table(spark, d, "extractions").select("file_id", "text", "method"), "file_id"), clean=True).select("file_id", "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Furniture blocks of pages that have content."""
    judged = fetched.judged_pages(table(spark, d, "fetched"))
    rows = judged.where("kind is null").dropDuplicates(["fetch_id"])
    return rows.select("fetch_id", F.explode("furniture").alias("block_no"))


def p2_main(spark: SparkSession, d: str) -> DataFrame:
    """The main body of each page that has content."""
    judged = fetched.judged_pages(table(spark, d, "fetched"), with_text=True)
    return judged.where("kind is null").select("fetch_id", "title", "text").dropDuplicates(["fetch_id"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pages = fetched.judged_pages(table(spark, d, "fetched")).where("kind is not null").select(F.lit("fetch").alias("rec"), F.col("fetch_id").alias("rec_id"), "kind")
    crawls = fetched.judged_entries(table(spark, d, "crawl_stats")).select(F.lit("crawl").alias("rec"), F.col("crawl_id").alias("rec_id"), "kind")
    return pages.unionByName(crawls).distinct()


def p5_holdout(spark: SparkSession, d: str) -> DataFrame:
    """The classifier against the labeller, on hosts it wasn't trained on."""
    return fetched.holdout(table(spark, d, "fetched"))


def _repeated(spark: SparkSession, d: str) -> DataFrame:
    reports = table(spark, d, "file_reports").select("file_id", lines.source_of(F.col("path")).alias("source"))
    return lines.repeated_lines(table(spark, d, "extractions"), reports)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of frequent clusters whose own form is as frequent."""
    found = _repeated(spark, d).where(F.col("form_files") >= lines.MIN_FILES)
    return found.select("file_id", F.col("line_no").cast("bigint").alias("line_no"))


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    """The texts without the lines their source repeats, near copies included."""
    return lines.without_lines(one_per_key(table(spark, d, "extractions").select("file_id", "text"), "file_id"), _repeated(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_items(table(spark, d, "chunks"), "chunk_id").select("chunk_id", "boundary").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "chunks"), "chunk_id", ["title"])


def p4_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """The texts put together again from their pieces, as a digest, and whether all pieces keep to the limit, the overlap and the order."""
    cut = p4_pieces(spark, d).groupBy("chunk_id").agg(F.first("title").alias("title"), F.sort_array(F.collect_list(F.struct("piece_no", "start", "text"))).alias("p"))
    overlap = splitting.OVERLAP
    rebuilt = F.array_join(F.transform("p", lambda x, i: F.when(i == 0, x.text).otherwise(F.substr(x.text, F.lit(overlap + 1)))), "")
    short = F.forall("p", lambda x: F.char_length(x.text) <= splitting.LIMIT)
    ends = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p")), lambda a, b: F.right(a.text, F.lit(overlap)) == F.left(b.text, F.lit(overlap)))
    return cut.select("chunk_id", "title", F.md5(rebuilt).alias("digest"), short.alias("within_limit"), F.forall(ends, lambda x: x).alias("overlapping"))


OVERLAP, SHARED, TERMS = 0.34, 3, 3


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    skills = one_per_key(table(spark, d, "skills").select("skill_id", "description"), "skill_id")
    sets = skills.select(F.col("skill_id").alias("id"), distinctive_terms(F.col("description")).alias("terms"))
    found = pairs.expand(*pairs.similar_pairs(sets, OVERLAP, SHARED, TERMS))
    return found.select(F.col("id_a").alias("skill_a"), F.col("id_b").alias("skill_b"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(table(spark, d, "documents"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sized = stored(tokenize.token_counts(table(spark, d, "documents"), ["doc_id", "source"]))
    targets = table(spark, d, "mix_targets")
    return mixing.mix(sized, targets), sized, targets


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_mix(spark, d))


def _pii(spark: SparkSession, d: str, replaced: bool = False) -> DataFrame:
    documents = table(spark, d, "documents")
    return pii.found(documents, pii.trained(documents, table(spark, d, "given_names")), replaced=replaced)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _pii(spark, d).select("doc_id", F.inline("pieces")).distinct()


def p9_replaced(spark: SparkSession, d: str) -> DataFrame:
    """The texts with a placeholder in place of each piece."""
    return _pii(spark, d, replaced=True).select("doc_id", "text")


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_clean": p1_clean, "p2_found": p2_found, "p2_main": p2_main, "p5_found": p5_found, "p5_holdout": p5_holdout, "p3_found": p3_found, "p3_clean": p3_clean, "p4_found": p4_found, "p4_pieces": p4_pieces, "p4_rebuilt": p4_rebuilt, "p6_found": p6_found, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_replaced": p9_replaced}


_P3 = r"""WITH e AS (SELECT DISTINCT file_id, text FROM extractions WHERE text IS NOT NULL), p AS (SELECT DISTINCT file_id, path FROM file_reports),
  s AS (SELECT file_id, CASE WHEN regexp_matches(path, '(?i)^https?://') THEN regexp_replace(regexp_replace(lower(regexp_extract(path, '(?i)^https?://(?:[^/?#]*@)?([^/?#]*)', 1)), ':[0-9]*$', ''), '^www\.', '')
    WHEN regexp_matches(path, '^[^/:]+/[^/:]+:') THEN regexp_extract(path, '^([^/:]+/[^/:]+):', 1) ELSE regexp_extract(path, '(?s)^(.*)[/\\]', 1) END AS source FROM p),
  l AS (SELECT file_id, unnest(x) AS raw, generate_subscripts(x, 1) AS line_no FROM (SELECT file_id, string_split(replace(replace(text, chr(8203), ''), chr(173), ''), chr(10)) AS x FROM e)),
  t AS (SELECT *, regexp_replace(raw, '^[<WS>]+', '') AS bare FROM l),
  f AS (SELECT *, regexp_matches(bare, '^(?:```|~~~)') AS fence, count(*) FILTER (regexp_matches(bare, '^(?:```|~~~)')) OVER (PARTITION BY file_id ORDER BY line_no) AS fences FROM t),
  n AS (SELECT file_id, line_no, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(raw), '\p{Nd}+', '0', 'g'), '[<WS>]+', ' ', 'g'), '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}]+$', '') AS form
    FROM f WHERE NOT fence AND fences % 2 = 0 AND NOT starts_with(bare, '#')),
  g AS (SELECT source, form FROM n JOIN s USING (file_id) WHERE length(form) >= 20 GROUP BY source, form HAVING count(DISTINCT file_id) >= 8)
  SELECT file_id, line_no FROM n JOIN s USING (file_id) JOIN g USING (source, form)"""

_P4 = r"""WITH c AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE length(text) > 2400),
  l AS (SELECT chunk_id, unnest(x) AS line, generate_subscripts(x, 1) AS n FROM (SELECT chunk_id, string_split(text, chr(10)) AS x FROM c)),
  f AS (SELECT *, regexp_replace(line, '^[<WS>]+', '') AS bare, count(*) FILTER (regexp_matches(line, '^[<WS>]*(?:```|~~~)')) OVER (PARTITION BY chunk_id ORDER BY n) AS fences FROM l),
  b AS (SELECT *, bare = '' AND fences % 2 = 0 AS blank FROM f),
  u AS (SELECT *, count(*) FILTER (blank) OVER (PARTITION BY chunk_id ORDER BY n) AS unit FROM b),
  v AS (SELECT chunk_id, max(size) AS longest FROM (SELECT chunk_id, unit, sum(length(line)) + count(*) - 1 AS size FROM u WHERE NOT blank GROUP BY chunk_id, unit) GROUP BY chunk_id),
  w AS (SELECT chunk_id, max(length(line)) AS longest, max(list_max(list_transform(string_split(regexp_replace(regexp_replace(line, '([.!?])([<WS>])', '\1' || chr(57345) || '\2', 'g'), '([。！？])', '\1' || chr(57345), 'g'), chr(57345)), lambda x: length(x)))) AS sentence FROM l GROUP BY chunk_id)
  SELECT chunk_id, CASE WHEN v.longest <= 2200 THEN 'blank' WHEN w.longest <= 2200 THEN 'line' WHEN w.sentence <= 2200 THEN 'sentence' ELSE 'none' END AS boundary FROM w LEFT JOIN v USING (chunk_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express over whole tables; the rest is held against brute force and held-out accuracy in the tests."""
    terms = f"WITH {skill_plans._S}, {skill_plans._T}, {skill_plans._OVERLAP} SELECT skill_a, skill_b FROM v"
    rebuilt = "SELECT DISTINCT chunk_id, title, md5(text) AS digest, true AS within_limit, true AS overlapping FROM chunks WHERE text IS NOT NULL"
    return {"p3_found": _P3.replace("<WS>", WS), "p4_rebuilt": rebuilt, "p4_found": _P4.replace("<WS>", WS), "p6_found": terms.replace("<WS>", WS)}
