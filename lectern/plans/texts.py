"""Queries on text functions and paged text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import paged
from lectern.plans.base import Registry
from lectern.sources.tables import one_per_key, table

R = Registry()

_TOKENS = "CAST(floor(len(regexp_extract_all(regexp_replace({0}, '[<CJK>]', ' ', 'g'), '[^<WS>]+')) / 0.75::DOUBLE + len(regexp_extract_all({0}, '[<CJK>]')) / 1.5::DOUBLE) AS BIGINT)"


@R.add(f"SELECT doc_id, {_TOKENS.format('text')} AS tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@R.add(f"SELECT origin, count(*) AS chunks, CAST(sum({_TOKENS.format('text')}) AS BIGINT) AS tokens FROM (SELECT DISTINCT * FROM chunks) GROUP BY origin")
def token_estimate_by_origin(spark: SparkSession, d: str) -> DataFrame:
    rows = one_per_key(table(spark, d, "chunks").select("chunk_id", "origin", T.estimate_tokens(F.col("text")).alias("n")), "chunk_id")
    return rows.groupBy("origin").agg(F.count("*").alias("chunks"), F.sum("n").alias("tokens"))


@R.add("SELECT DISTINCT file_id, CAST(length(text) - length(regexp_replace(text, '[<INVISIBLE>]', '', 'g')) AS BIGINT) AS removed, md5(regexp_replace(text, '[<INVISIBLE>]', '', 'g')) AS clean FROM extractions")
def sanitize_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "extractions")
    return e.select("file_id", T.invisible_count(F.col("text")).alias("removed"), F.md5(T.sanitize(F.col("text"))).alias("clean")).distinct()


#: FNV-1a as a fold over the bytes, in integers of 128 bits.
FOLD = "lower(lpad(to_hex(CAST(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda b: CAST(('0x' || b)::INTEGER AS UHUGEINT))), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS UBIGINT)), 16, '0'))"


@R.add(f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN {FOLD.format('text')} END AS hash FROM documents")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.fingerprint("text").alias("hash"))


@R.add(
    f"""WITH e AS (SELECT DISTINCT file_id, regexp_replace(text, '[<INVISIBLE>]', '', 'g') AS t FROM extractions WHERE text IS NOT NULL)
    SELECT count(*) AS files, count(*) AS same_hash, count(*) AS same_characters, count(*) FILTER ({_TOKENS.format('t')} = estimated_tokens) AS same_tokens
    FROM e JOIN (SELECT DISTINCT file_id, estimated_tokens FROM file_reports) f USING (file_id)"""
)
def report_facts_hold(spark: SparkSession, d: str) -> DataFrame:
    """The stored hash, length and token estimate of each file, computed again from its text; hashes and lengths are to hold throughout."""
    e = table(spark, d, "extractions").select("file_id", "text").where("text is not null")
    r = one_per_key(table(spark, d, "file_reports").select("file_id", "content_hash", "characters", "estimated_tokens"), "file_id")
    clean = e.select("file_id", T.sanitize(F.col("text")).alias("t"))
    facts = clean.select("file_id", T.fingerprint("t").alias("h"), F.char_length("t").alias("n"), T.estimate_tokens(F.col("t")).alias("k"))
    j = one_per_key(facts, "file_id").join(r, "file_id")
    return j.agg(F.count("*").alias("files"), F.count_if(F.col("h") == F.col("content_hash")).alias("same_hash"), F.count_if(F.col("n") == F.col("characters")).alias("same_characters"), F.count_if(F.col("k") == F.col("estimated_tokens")).alias("same_tokens"))


@R.add(r"SELECT doc_id, md5(regexp_replace(text, '([\p{L}\p{N}\p{M}_])-\n([\p{L}\p{N}\p{M}_])', '\1\2', 'g')) AS joined FROM documents")
def dehyphenate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.dehyphenate(F.col("text"))).alias("joined"))


_BARE = "regexp_replace(regexp_replace({0}, '^[<WS>]+', ''), '[<WS>]+$', '')"
_IS_PAGE = "({0} <> '' AND regexp_matches({0}, '^(?:[0-9]{{1,4}}|(?i:(?:xc|xl|l?x{{0,3}})(?:ix|iv|v?i{{0,3}})))$'))"


@R.add(
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), b AS (SELECT doc_id, {_BARE.format('line')} AS bare FROM l)
    SELECT bare, count(*) AS n FROM b WHERE {_IS_PAGE.format('bare')} GROUP BY bare"""
)
def page_number_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line")).where(T.is_page_number(F.col("line")))
    return rows.groupBy(T.trim(F.col("line")).alias("bare")).agg(F.count("*").alias("n"))


_PAGED = f"""p AS (SELECT doc_id, string_split(text, chr(12)) AS pages FROM documents WHERE len(string_split(text, chr(12))) >= 3),
  q AS (SELECT doc_id, len(pages) AS n, unnest(pages) AS page, generate_subscripts(pages, 1) AS page_no FROM p),
  r AS (SELECT doc_id, n, page_no, unnest(string_split(page, chr(10))) AS line, generate_subscripts(string_split(page, chr(10)), 1) AS line_no FROM q),
  l AS (SELECT *, {_BARE.format('line')} AS bare FROM r),
  e AS (SELECT *, line_no = min(CASE WHEN bare <> '' THEN line_no END) OVER w AS is_first, line_no = max(CASE WHEN bare <> '' THEN line_no END) OVER w AS is_last FROM l WINDOW w AS (PARTITION BY doc_id, page_no)),
  h AS (SELECT doc_id, bare, count(DISTINCT page_no) AS edges FROM e WHERE is_first OR is_last GROUP BY doc_id, bare, n HAVING count(DISTINCT page_no) > n // 2)"""


@R.add(f"WITH {_PAGED} SELECT doc_id, bare, edges FROM h")
def running_headers(spark: SparkSession, d: str) -> DataFrame:
    return paged.running_headers(table(spark, d, "documents"), "doc_id", "text")


@R.add(
    f"""WITH {_PAGED},
  k AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = e.doc_id AND h.bare = e.bare) AND NOT ({_IS_PAGE.format('bare')} AND coalesce(is_first OR is_last, false))),
  j AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY page_no, line_no) AS t FROM k GROUP BY doc_id),
  a AS (SELECT doc_id, coalesce(t, '') AS t FROM p LEFT JOIN j USING (doc_id) UNION ALL SELECT doc_id, replace(text, chr(12), chr(10)) FROM documents WHERE text IS NULL OR len(string_split(text, chr(12))) < 3)
  SELECT doc_id, md5(regexp_replace(t, '([\\p{{L}}\\p{{N}}\\p{{M}}_])-\\n([\\p{{L}}\\p{{N}}\\p{{M}}_])', '\\1\\2', 'g')) AS clean FROM a"""
)
def clean_paged_text(spark: SparkSession, d: str) -> DataFrame:
    return paged.clean_paged_text(table(spark, d, "documents")).select("doc_id", F.md5("text").alias("clean"))


@R.add(
    """SELECT DISTINCT file_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(pages_with_tables, []::INT[]),
    CASE WHEN coalesce(page_count, 0) > 0 AND len(coalesce(pages_with_columns, []::INT[])) * 2 > page_count THEN []::INT[] ELSE coalesce(pages_with_columns, []::INT[]) END))), ',') AS pages FROM extractions"""
)
def pdf_supplement(spark: SparkSession, d: str) -> DataFrame:
    pages = paged.pages_to_supplement(F.col("pages_with_tables"), F.col("pages_with_columns"), F.col("page_count"))
    return table(spark, d, "extractions").select("file_id", F.array_join(pages, ",").alias("pages")).distinct()


_SLUG = "lower(left(trim(regexp_replace({0}, '[^A-Za-z0-9]+', '-', 'g'), '-'), 64))"


@R.add(f"SELECT p_partkey, {_SLUG.format('p_name')} AS slug FROM part")
def slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"))


@R.add(f"SELECT DISTINCT chunk_id, {_SLUG.format('title')} AS slug FROM chunks")
def slug_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", T.slug(F.col("title")).alias("slug")).distinct()


_FLAT = "regexp_replace(" + _BARE + ", '[<WS>]+', ' ', 'g')"


@R.add(f"SELECT doc_id, CASE WHEN length(f) > 160 THEN left(f, 157) || '...' ELSE f END AS line FROM (SELECT doc_id, {_FLAT.format('text')} AS f FROM documents)")
def one_line(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.one_line(F.col("text")).alias("line"))


@R.add("SELECT DISTINCT chunk_id, md5(substr(text, 1001, 1000)) AS part, CAST(length(text) AS BIGINT) AS total, CAST(CASE WHEN length(text) > 2000 THEN 2000 END AS BIGINT) AS next_at FROM chunks")
def read_slice(spark: SparkSession, d: str) -> DataFrame:
    s = T.read_slice(F.col("text"), 1000, 1000)
    return table(spark, d, "chunks").select("chunk_id", F.md5(s["part"]).alias("part"), s["total"].alias("total"), s["next"].alias("next_at")).distinct()


@R.add(
    """SELECT DISTINCT skill_id, CASE WHEN length(n) >= 2 AND left(n, 1) = right(n, 1) AND left(n, 1) IN ('"', '''') THEN substr(n, 2, length(n) - 2) ELSE n END AS bare,
    replace(replace(path, '/', chr(92)), chr(92), '/') AS path FROM (SELECT skill_id, '"' || name || '"' AS n, path FROM skills)"""
)
def unquote(spark: SparkSession, d: str) -> DataFrame:
    quoted = F.concat(F.lit('"'), F.col("name"), F.lit('"'))
    windows = F.replace("path", F.lit("/"), F.lit("\\"))
    return table(spark, d, "skills").select("skill_id", T.unquote(quoted).alias("bare"), T.slashes(windows).alias("path")).distinct()


@R.add("SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM orders")
def civil_date(spark: SparkSession, d: str) -> DataFrame:
    days = T.civil_date(F.unix_date(F.to_date("o_orderdate")))
    return table(spark, d, "orders").select("o_orderkey", F.year(days).cast("bigint").alias("y"), F.month(days).cast("bigint").alias("m"), F.day(days).cast("bigint").alias("day"), T.iso_time(F.col("o_orderdate")).alias("iso"))
