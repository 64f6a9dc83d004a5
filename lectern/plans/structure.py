"""Queries on chapters, sections and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import chapters as C
from lectern.functions.text import estimate_tokens, lines
from lectern.operators import chunking as K
from lectern.plans.base import Registry
from lectern.plans.texts import _BARE, _TOKENS
from lectern.sources.tables import one_per_key, table

R = Registry()

_ROMAN = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in C.ROMAN.items()) + "}"
_TAIL = r"(?:[<WS>]*$|[<WS>]*[.:\-—–]|[<WS>]+[A-ZÀ-Þ0-9\"“(])"
_LINES = "l AS (SELECT doc_id, n AS line_no, rtrim(line, chr(13)) AS line FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS n FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS x FROM documents WHERE text <> '')))"


def _number(s: str) -> str:
    w = r"^(?i:(?:chapter|chapitre|kapitel|cap[ií]tulo|capitolo|hoofdstuk|ch\.?))[<WS>]*"
    cn = "nullif(regexp_extract({0}, '^第[<WS>]*([0-9]+)[<WS>]*[章回卷节篇讲]', 1), '')"
    return f"""CASE WHEN length({s}) > 80 THEN NULL
      WHEN regexp_matches({s}, '{w}([0-9]{{1,2}})(?:[^\\p{{L}}\\p{{N}}_]|$)') AND regexp_matches({s}, '{w}[0-9]{{1,2}}{_TAIL}') THEN CAST(regexp_extract({s}, '{w}([0-9]{{1,2}})', 1) AS INT)
      WHEN regexp_matches({s}, '{w}[IVXLCDMivxlcdm]{{1,7}}(?:[^\\p{{L}}\\p{{N}}_]|$)') AND regexp_matches({s}, '{w}[IVXLCDMivxlcdm]{{1,7}}{_TAIL}') THEN {_ROMAN}[upper(regexp_extract({s}, '{w}([IVXLCDMivxlcdm]{{1,7}})', 1))]
      WHEN regexp_matches({s}, '^[IVXLCDM]+[<WS>]*[:.][<WS>]+[A-ZÀ-Þ0-9\\"“(]') THEN {_ROMAN}[regexp_extract({s}, '^([IVXLCDM]+)', 1)]
      WHEN {cn.format(s)} IS NOT NULL THEN CASE WHEN CAST({cn.format(s)} AS INT) BETWEEN 1 AND 999 THEN CAST({cn.format(s)} AS INT) END END"""


_HEADS = f"""{_LINES}, b AS (SELECT doc_id, line_no, {_BARE.format('line')} AS s FROM l),
  h AS (SELECT doc_id, line_no, s, coalesce({_number('s')}, CASE WHEN regexp_matches(s, '^(?:#{{1,6}}|={{1,6}})[<WS>]+') THEN {_number("regexp_replace(s, '^(?:#{1,6}|={1,6})[<WS>]+', '')")} END) AS n FROM b WHERE length(s) <= 90)"""


@R.add(f"WITH {_HEADS} SELECT doc_id, line_no, n FROM h WHERE n IS NOT NULL")
def chapter_number(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(lines(F.col("text"))).alias("i", "line"))
    return rows.select("doc_id", (F.col("i") + 1).cast("bigint").alias("line_no"), C.chapter_number(F.col("line")).alias("n")).where("n is not null")


_STRUCT = f"""{_LINES}, q AS (SELECT doc_id, line_no, {_BARE.format('line')} AS s FROM l),
  f AS (SELECT *, regexp_matches(s, '^(?:```|~~~)') AS fence, count(*) FILTER (regexp_matches(s, '^(?:```|~~~)')) OVER (PARTITION BY doc_id ORDER BY line_no) AS fences FROM q),
  k AS (SELECT *, NOT fence AND fences % 2 = 1 AS inside, regexp_matches(s, '^(?:={{2,}}|-{{2,}})$') AS rule, regexp_extract(s, '^(#{{1,6}}|={{1,6}})[<WS>]+.+', 1) AS mark FROM f),
  g AS (SELECT *, lag(CASE WHEN fence OR inside OR mark <> '' THEN '' ELSE s END) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev, lag(rule) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev_rule FROM k),
  t AS (SELECT DISTINCT doc_id, CASE WHEN s LIKE '=%' THEN 1 ELSE 2 END AS depth, lower(prev) AS title FROM g WHERE rule AND NOT inside AND coalesce(prev, '') <> '' AND NOT prev_rule AND length(s) >= length(prev)
    UNION SELECT DISTINCT doc_id, length(mark), lower({_BARE.format("regexp_replace(regexp_replace(s, '^(#{1,6}|={1,6})[<WS>]+', ''), '[<WS>]*#*$', '')")}) FROM g WHERE mark <> '' AND NOT fence AND NOT inside),
  u AS (SELECT doc_id, depth, count(*) AS n FROM t WHERE title <> '' AND NOT regexp_matches(title, '^[0-9]') AND regexp_matches(title, '[\\p{{L}}\\p{{N}}_]') GROUP BY doc_id, depth),
  v AS (SELECT doc_id, coalesce(arg_min(n, depth) FILTER (n >= 2), sum(n)) AS n FROM u GROUP BY doc_id)"""


@R.add(f"WITH {_STRUCT} SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS chapters FROM documents LEFT JOIN v USING (doc_id) WHERE text IS NOT NULL")
def structural_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", C.structural_count("text").alias("chapters"))


_TOC_SQL = C.TOC.replace("(?imu)", "(?im)")


@R.add(f"SELECT doc_id, regexp_matches(left(text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'Contents' ELSE '' END, 30000), '{_TOC_SQL}') AS has_toc FROM documents WHERE text IS NOT NULL")
def has_toc(spark: SparkSession, d: str) -> DataFrame:
    """A third of the documents is given a line that heads a table of contents."""
    text = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "\nContents").otherwise(""))
    return table(spark, d, "documents").where("text is not null").select("doc_id", C.has_toc(text).alias("has_toc"))


@R.add(
    f"""WITH {_HEADS}, {_STRUCT.replace(_LINES + ', ', '')}, c AS (SELECT doc_id, count(DISTINCT n) AS n, array_to_string((list(s ORDER BY line_no))[1:10], ' / ') AS sample FROM h WHERE n IS NOT NULL GROUP BY doc_id)
    SELECT doc_id, CAST(coalesce(c.n, v.n, 0) AS BIGINT) AS chapters, coalesce(sample, '') AS sample, regexp_matches(left(text, 30000), '{_TOC_SQL}') AS has_toc FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN v USING (doc_id) WHERE text IS NOT NULL"""
)
def chapter_counts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").where("text is not null").select("doc_id", C.structure(F.col("text")).alias("s"))
    return s.select("doc_id", F.col("s.chapters").alias("chapters"), F.array_join("s.sample", " / ").alias("sample"), F.col("s.has_toc").alias("has_toc"))


_SECTIONS = f"""{_LINES}, q AS (SELECT doc_id, line_no, line, ltrim(line, ' ' || chr(9)) AS s FROM l),
  f AS (SELECT *, count(*) FILTER (regexp_matches(s, '^(?:```|~~~)')) OVER (PARTITION BY doc_id ORDER BY line_no) AS fences FROM q),
  h AS (SELECT *, fences % 2 = 0 AND regexp_matches(s, '^# ') AND {_BARE.format('substr(s, 3)')} <> '' AS head FROM f),
  g AS (SELECT *, count(*) FILTER (head) OVER (PARTITION BY doc_id ORDER BY line_no) AS sec FROM h),
  t AS (SELECT doc_id, sec, coalesce(max(CASE WHEN head THEN {_BARE.format('substr(s, 3)')} END), 'Opening') AS title, string_agg(line || chr(10), '' ORDER BY line_no) FILTER (NOT head) AS text FROM g GROUP BY doc_id, sec),
  z AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) AS part_no, title, nullif({_BARE.format("regexp_extract(text, '(?:^|\\n)[ \\t]*source: ([^\\n]*)', 1)")}, '') AS origin, text FROM t WHERE {_BARE.format("coalesce(text, '')")} <> '')"""


@R.add(f"WITH {_SECTIONS} SELECT doc_id, part_no, title, origin, md5(text) AS text FROM z")
def sections(spark: SparkSession, d: str) -> DataFrame:
    return K.section_rows(table(spark, d, "documents"), "doc_id").select("doc_id", F.col("part_no").cast("bigint").alias("part_no"), "title", "origin", F.md5("text").alias("text"))


#: A small budget, so that the test tables' documents make several chunks.
BUDGET = 400
_EST = _TOKENS.format("{0}")


@R.add()
def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    """The sections of each document, packed; the packing is tested against its invariants, as its fold has no counterpart in SQL."""
    return K.chunk_rows(table(spark, d, "documents"), "doc_id", most=BUDGET).select("doc_id", "part_no", F.md5("title").alias("title"), "origin", F.md5("text").alias("text"), estimate_tokens(F.col("text")).alias("tokens"))


_PURPOSE = ", ".join(f"('{p}', {n})" for p, n in K.PURPOSES.items())


@R.add(
    f"""SELECT origin, purpose, budget, count(*) AS chunks, CAST(sum({_TOKENS.format('text')}) AS BIGINT) AS tokens, CAST(max({_TOKENS.format('text')}) AS BIGINT) AS largest
    FROM (SELECT DISTINCT * FROM chunks), (VALUES {_PURPOSE}) p(purpose, budget) GROUP BY origin, purpose, budget"""
)
def build_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = one_per_key(table(spark, d, "chunks").select("chunk_id", "origin", estimate_tokens(F.col("text")).alias("n")), "chunk_id")
    total = rows.groupBy("origin").agg(F.count("*").alias("chunks"), F.sum("n").alias("tokens"), F.max("n").alias("largest"))
    purposes = F.array(*[F.struct(F.lit(p).alias("purpose"), F.lit(n).alias("budget")) for p, n in K.PURPOSES.items()])
    return total.select("origin", F.inline(purposes), "chunks", "tokens", "largest")


@R.add("WITH c AS (SELECT DISTINCT * FROM crawl_stats), e AS (SELECT crawl_id, start_url, unnest(errors) AS note, generate_subscripts(errors, 1) AS o FROM c) SELECT crawl_id::VARCHAR AS source, string_agg('- ' || note, chr(10) ORDER BY o) AS gaps FROM e WHERE trim(note) <> '' GROUP BY crawl_id")
def gap_summary(spark: SparkSession, d: str) -> DataFrame:
    c = one_per_key(table(spark, d, "crawl_stats").select("crawl_id", "errors"), "crawl_id")
    return K.gap_summary(c.select(F.col("crawl_id").cast("string").alias("source"), F.posexplode("errors").alias("ordinal", "note")))


@R.add(
    """WITH s AS (SELECT DISTINCT ON (skill_id) * FROM skills) SELECT skill_id, 'SKILL.md' AS path, md5('# ' || dir_name || chr(10)) AS body, NULL AS error FROM s WHERE skill_id % 7 NOT IN (0, 3)
    UNION ALL SELECT skill_id, 'references/a.md', md5(replace(body || chr(10), chr(13), '')), NULL FROM s WHERE skill_id % 7 NOT IN (0, 3) AND trim(body) <> ''
    UNION ALL SELECT skill_id, NULL, NULL, 'no file blocks' FROM s WHERE skill_id % 7 = 0 UNION ALL SELECT skill_id, NULL, NULL, 'outside the folder: ../x.md' FROM s WHERE skill_id % 7 = 3"""
)
def parse_file_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Replies made from skills: two files and an empty one; some without blocks, some that lead out of the folder."""
    s = one_per_key(table(spark, d, "skills").select("skill_id", "dir_name", "body"), "skill_id")
    good = F.concat(F.lit("Here:\n=== FILE: `SKILL.md` ===\n# "), "dir_name", F.lit("\n=== FILE: references\\a.md ===\n"), "body", F.lit("\n=== FILE: empty.md ===\n \n"))
    reply = F.when(F.col("skill_id") % 7 == 0, F.col("body")).when(F.col("skill_id") % 7 == 3, F.lit("=== FILE: ../x.md ===\nx\n")).otherwise(good)
    blocks = K.file_blocks(s.select("skill_id", reply.alias("reply")), "skill_id")
    return blocks.select("skill_id", "path", F.md5("body").alias("body"), "error")


@R.add(
    r"""WITH s AS (SELECT DISTINCT start_url FROM crawl_stats), p AS (SELECT start_url, list_filter(string_split(regexp_replace(start_url, '/+$', ''), '/'), lambda x: (x <> '' AND NOT contains(x, '.')) OR (contains(x, '.') AND octet_length(encode(x)) > 4)) AS parts FROM s),
    c AS (SELECT start_url, trim(lower(regexp_replace(string_split(coalesce(parts[len(parts)], start_url), '.')[1], '[^A-Za-z0-9]+', '-', 'g')), '-') AS name FROM p)
    SELECT start_url, CASE WHEN length(name) >= 3 THEN left(name, 64) ELSE 'opening' END AS name FROM c"""
)
def derive_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_stats").select("start_url").distinct().select("start_url", K.derive_name(F.col("start_url"), F.lit("Opening")).alias("name"))
