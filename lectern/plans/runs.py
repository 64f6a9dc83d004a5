"""Queries on sources, crawls, reports, snapshots and examinations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import urls as U
from lectern.operators import crawl as W
from lectern.operators import evals as E
from lectern.operators import report as P
from lectern.operators import snapshots as N
from lectern.operators import sources as S
from lectern.plans.base import Registry
from lectern.plans.texts import FOLD, _BARE, _TOKENS
from lectern.sources.tables import one_per_key, table

R = Registry()

_F = "f AS (SELECT DISTINCT ON (file_id) * FROM file_reports)"


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return one_per_key(table(spark, d, "file_reports"), "file_id")


# sources


_CASES = """CASE file_id % 9 WHEN 0 THEN path WHEN 1 THEN 'https://github.com/own/rep.git.git/tree/main/' || file_id || '/b' WHEN 2 THEN 'https://www.github.com/own/rep/blob/v1/' || file_id || '.md' WHEN 3 THEN 'gh:own/rep/sub/x@dev'
  WHEN 4 THEN 'git@host.example:own/rep' || file_id || '.git' WHEN 5 THEN 'own/rep-' || file_id || '@v2' WHEN 6 THEN ' https://gitlab.com/g/p' || file_id || '.git ' WHEN 7 THEN 'https://github.com/own/rep' || file_id ELSE 'gh:' || file_id END"""


@R.add(
    f"""WITH {_F}, r AS (SELECT file_id, trim({_CASES}) AS raw, path FROM f)
  SELECT file_id, CASE file_id % 9 WHEN 0 THEN CASE WHEN regexp_matches(raw, '^https?://') THEN 'web' ELSE 'file' END WHEN 2 THEN 'web' WHEN 8 THEN 'error' ELSE 'repo' END AS kind,
  CASE file_id % 9 WHEN 1 THEN 'https://github.com/own/rep.git' WHEN 2 THEN 'https://raw.githubusercontent.com/own/rep/v1/' || file_id || '.md' WHEN 3 THEN 'https://github.com/own/rep.git' WHEN 4 THEN raw
   WHEN 5 THEN 'https://github.com/own/rep-' || file_id || '.git' WHEN 6 THEN 'https://gitlab.com/g/p' || file_id || '.git' WHEN 7 THEN 'https://github.com/own/rep' || file_id || '.git' WHEN 8 THEN file_id::VARCHAR ELSE NULL END AS url,
  CASE file_id % 9 WHEN 1 THEN 'main' WHEN 3 THEN 'dev' WHEN 5 THEN 'v2' END AS branch, CASE file_id % 9 WHEN 1 THEN file_id || '/b' WHEN 3 THEN 'sub/x' END AS subdir,
  CASE file_id % 9 WHEN 1 THEN 'own/rep' WHEN 3 THEN 'own/rep' WHEN 4 THEN 'rep' || file_id WHEN 5 THEN 'own/rep-' || file_id WHEN 6 THEN 'g/p' || file_id WHEN 7 THEN 'own/rep' || file_id END AS label FROM r"""
)
def classify_source(spark: SparkSession, d: str) -> DataFrame:
    """Every form a source can have, by turns; web addresses and local paths come from the table."""
    c = S.classify(F.expr(_CASES))
    rows = _reports(spark, d).select("file_id", c.alias("c"))
    plain = F.col("file_id") % 9 == 0
    return rows.select("file_id", "c.kind", F.when(~plain, F.col("c.url")).alias("url"), "c.branch", "c.subdir", "c.label")


def _values(pairs: dict[str, str]) -> str:
    return "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in pairs.items()) + ")"


_ROUTES = _values({e: r for r, es in S.ROUTES.items() for e in es})
_EXT = r"nullif(lower(regexp_extract(regexp_replace({0}, '[?#].*$', ''), '[^/\\]\.([^./\\]+)$', 1)), '')"


@R.add(f"WITH {_F} SELECT file_id, {_EXT.format('path')} AS ext, route FROM f LEFT JOIN {_ROUTES} m(ext, route) ON m.ext = {_EXT.format('path')}")
def route_by_ext(spark: SparkSession, d: str) -> DataFrame:
    ext = S.path_extension(F.col("path"))
    return _reports(spark, d).select("file_id", ext.alias("ext"), S.route(ext).alias("route"))


@R.add(
    "SELECT unnest(string_split('adoc asciidoc azw azw3 csv doc docm docx epub htm html markdown md mobi odp ods odt pdf pot pps ppsm ppsx ppt pptm pptx rst rtf text txt xhtml xls xlsb xlsm xlsx', ' ')) AS ext"
)
def list_formats(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, S.formats()))).alias("ext"))


_UEXT = r"nullif(lower(regexp_extract(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '\.([A-Za-z0-9]+)/*$', 1)), '')"


@R.add(
    f"""WITH f AS (SELECT DISTINCT fetch_id, url, content_type FROM fetched) SELECT fetch_id, coalesce(m.ext, {_UEXT}, 'html') AS ext,
    CASE WHEN content_type IS NOT NULL THEN lower(content_type) LIKE '%html%' OR lower(content_type) LIKE '%xml+xhtml%' ELSE coalesce({_UEXT} IN ('html', 'htm', 'xhtml'), true) END AS html
    FROM f LEFT JOIN {_values(S.MIME)} m(mime, ext) ON m.mime = trim(string_split(content_type, ';')[1])"""
)
def mime_ext(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fetched").select("fetch_id", "url", "content_type").distinct()
    return f.select("fetch_id", S.download_extension(F.col("content_type"), F.col("url")).alias("ext"), S.is_html(F.col("content_type"), F.col("url")).alias("html"))


@R.add(
    f"""WITH f AS (SELECT DISTINCT fetch_id, url, content_type FROM fetched), e AS (SELECT fetch_id, coalesce(m.ext, {_UEXT}, 'html') AS ext, trim(regexp_replace(regexp_extract(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '([^/]*)/*$', 1), '[^A-Za-z0-9._-]', '_', 'g'), '_') AS seg
      FROM f LEFT JOIN {_values(S.MIME)} m(mime, ext) ON m.mime = trim(string_split(content_type, ';')[1])),
    s AS (SELECT fetch_id, ext, CASE WHEN seg = '' THEN 'download' WHEN lower(seg) LIKE '%.' || ext THEN left(seg, length(seg) - length(ext) - 1) ELSE seg END AS stem FROM e),
    n AS (SELECT *, row_number() OVER (PARTITION BY stem, ext ORDER BY fetch_id) AS n FROM s) SELECT fetch_id, stem || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.' || ext AS name FROM n"""
)
def download_names(spark: SparkSession, d: str) -> DataFrame:
    return S.download_names(table(spark, d, "fetched").select("fetch_id", "url", "content_type").distinct(), "fetch_id")


_REPO = f"{_F}, p AS (SELECT DISTINCT split_part(path, ':', 1) AS repo, substr(path, strpos(path, ':') + 1) AS file FROM f WHERE regexp_matches(path, '^[^/:]+/[^/:]+:'))"


def _files(spark: SparkSession, d: str) -> DataFrame:
    form = r"^([^/:]+/[^/:]+):(.*)$"
    return _reports(spark, d).where(F.col("path").rlike(form)).select(F.regexp_extract("path", form, 1).alias("repo"), F.regexp_extract("path", form, 2).alias("file")).distinct()


_RANK = "CASE WHEN starts_with(lower(regexp_extract(file, '([^/]*)$', 1)), 'readme') AND file NOT LIKE '%/%' THEN 0 WHEN regexp_matches(lower(file), '^(?:docs|doc|guide)/') THEN 1 WHEN starts_with(lower(regexp_extract(file, '([^/]*)$', 1)), 'readme') THEN 2 ELSE 3 END"
_SKIP = "|".join(S.SKIP_DIRS)


@R.add(
    rf"""WITH {_REPO}, k AS (SELECT repo, file, {_RANK} AS rank FROM p WHERE NOT regexp_matches(file, '(?:^|/)\.') AND NOT regexp_matches(file, '(?:^|/)(?:{_SKIP})/') AND regexp_matches(lower(file), '\.(?:{"|".join(S.DOC_EXTENSIONS)})$')),
    n AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY rank, file) AS place, count(*) OVER (PARTITION BY repo) AS total FROM k) SELECT repo, file, rank, place, greatest(total - 200, 0) AS dropped FROM n WHERE place <= 200"""
)
def repo_select(spark: SparkSession, d: str) -> DataFrame:
    return S.repo_select(_files(spark, d), "repo", "file")


@R.add(
    r"""WITH """ + _REPO + r""" SELECT repo, file, regexp_matches(file, '(?is)^docs/[^/]*$') AS in_docs, regexp_matches(file, '(?is)^(?:.*/)?[^/]*\.md$') AS any_md, regexp_matches(file, '(?is)^src/.*$') AS under_src, regexp_matches(file, '(?is)^[^/][^/][^/]/.*-[^/]*$') AS three FROM p"""
)
def glob_match(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("file")
    return _files(spark, d).select("repo", "file", S.glob_matches(f, "docs/*").alias("in_docs"), S.glob_matches(f, "**/*.MD").alias("any_md"), S.glob_matches(f, "src/**").alias("under_src"), S.glob_matches(f, "???/**-*").alias("three"))


@R.add(f"SELECT DISTINCT file_id, CASE WHEN {_BARE.format(chr(39) * 0 + 'coalesce(text, ' + chr(39) * 2 + ')')} <> '' THEN 'read' WHEN coalesce(len(pages_needing_ocr), 0) > 0 THEN 'visual' ELSE 'failed' END AS outcome FROM extractions")
def failures_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extractions").select("file_id", S.read_outcome(F.col("text"), F.col("pages_needing_ocr")).alias("outcome")).distinct()


@R.add(
    f"""WITH k AS (SELECT source, doc_id, path, method, text, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE {_BARE.format("coalesce(text, '')")} <> '')
    SELECT source, doc_id, md5(CASE WHEN n > 1 AND method <> 'web-page' THEN '# ' || path || chr(10) || chr(10) || text ELSE text END) AS part FROM k"""
)
def combined_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return S.combined_text(docs, "source", "doc_id", F.col("path"), F.coalesce(F.col("method") != "web-page", F.lit(False))).select("source", "doc_id", F.md5("part").alias("part"))


# reports


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    """The files with their sources, copies of rows included."""
    e = table(spark, d, "extractions").select("file_id", "text", "pages_needing_ocr")
    return e.join(_reports(spark, d).select("file_id", F.coalesce("origin", F.lit("(local)")).alias("source")), "file_id")


_RUN = f"""WITH {_F}, e AS (SELECT DISTINCT ON (file_id) * FROM extractions), j AS (SELECT coalesce(origin, '(local)') AS source, regexp_replace(text, '[<INVISIBLE>]', '', 'g') AS t, {_BARE.format("coalesce(text, '')")} <> '' AS ok, coalesce(len(e.pages_needing_ocr), 0) > 0 AS look FROM e JOIN f USING (file_id))
    SELECT source, count(*) FILTER (ok OR look) AS documents, CAST(coalesce(sum(length(t)) FILTER (ok), 0) AS BIGINT) AS characters, CAST(coalesce(sum({_TOKENS.format('t')}) FILTER (ok), 0) AS BIGINT) AS estimated_tokens, count(*) FILTER (NOT ok AND NOT look) AS failures, count(*) FILTER (look) AS visual FROM j GROUP BY source"""


@R.add(_RUN)
def run_report(spark: SparkSession, d: str) -> DataFrame:
    return P.run_report(_extracted(spark, d), "source", "file_id")


@R.add(f"SELECT source, CAST(json_object('source', source, 'documents', documents, 'characters', characters, 'estimated_tokens', estimated_tokens, 'failures', failures, 'visual', visual) AS VARCHAR) AS report FROM ({_RUN})")
def run_report_json(spark: SparkSession, d: str) -> DataFrame:
    """The report as JSON, one object per source; the figures are those of run_report."""
    return P.as_json(P.run_report(_extracted(spark, d), "source", "file_id"))


@R.add(f"WITH {_F} SELECT DISTINCT f.path, array_to_string(e.pages_needing_ocr, ',') AS pages FROM extractions e JOIN f USING (file_id) WHERE len(e.pages_needing_ocr) > 0")
def visual_reading(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "extractions").select("file_id", "pages_needing_ocr")
    return P.visual_requests(pages.join(_reports(spark, d).select("file_id", "path"), "file_id"), "path")


@R.add(
    f"""WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[<INVISIBLE>]', '', 'g') AS c FROM documents)
    SELECT doc_id, n - length(c) AS invisible_codepoints_removed, {FOLD.format('c')} AS content_hash, length(c) AS characters, {_TOKENS.format('c')} AS estimated_tokens FROM t"""
)
def doc_facts(spark: SparkSession, d: str) -> DataFrame:
    return P.doc_facts(table(spark, d, "documents").select("doc_id", "text"), "doc_id").drop("text")


# crawls


_ROBOTS = "User-agent: *\nDisallow: /\n\nUser-agent: Other\nUser-agent: Lectern # us\nDisallow: /api\nAllow: /api/*-r\nDisallow: /*.html$\nDisallow:\nCrawl-delay: 3\n\nUser-agent: lec\nDisallow: /help/"


@R.add(
    r"""WITH u AS (SELECT DISTINCT fetch_id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS p FROM fetched), m AS (SELECT fetch_id, p, CASE WHEN starts_with(p, '/api') THEN 4 ELSE -1 END AS a,
      CASE WHEN starts_with(p, '/api/') AND contains(substr(p, 6), '-r') THEN 7 ELSE -1 END AS b, CASE WHEN regexp_matches(p, '^[^.]*\.html$') THEN 6 ELSE -1 END AS c, CASE WHEN starts_with(p, '/help/') THEN 6 ELSE -1 END AS h FROM u)
    SELECT fetch_id, b >= greatest(a, c, h) AS allowed FROM m"""
)
def robots_allow(spark: SparkSession, d: str) -> DataFrame:
    """One set of rules for all sites of the crawl."""
    u = table(spark, d, "fetched").select("fetch_id", U.parse(F.col("url")).alias("u")).distinct().select("fetch_id", U.origin(F.col("u")).alias("origin"), F.col("u.path").alias("path"))
    robots = u.select("origin").distinct().withColumn("body", F.lit(_ROBOTS))
    return W.robots_allow(u, robots, "fetch_id")


_SITE = "f AS (SELECT DISTINCT crawl_id, url FROM fetched), n AS (SELECT crawl_id, url, row_number() OVER (PARTITION BY crawl_id ORDER BY url) AS n FROM f)"


@R.add(
    f"""WITH RECURSIVE {_SITE}, l AS (SELECT a.crawl_id, a.url AS source, b.url AS target FROM n a JOIN n b ON a.crawl_id = b.crawl_id AND b.n IN (2 * a.n, 2 * a.n + 1, 1)),
    w AS (SELECT crawl_id AS crawl, url AS page, 0 AS depth FROM n WHERE n = 1 UNION SELECT l.crawl_id, l.target, w.depth + 1 FROM w JOIN l ON l.crawl_id = w.crawl AND l.source = w.page WHERE w.depth < 3),
    g AS (SELECT crawl, page, min(depth) AS depth FROM w GROUP BY crawl, page) SELECT g.crawl, g.page, g.depth, n.n AS place FROM g JOIN n ON n.crawl_id = g.crawl AND n.url = g.page WHERE n.n <= 50"""
)
def crawl_bfs(spark: SparkSession, d: str) -> DataFrame:
    """Each crawl's pages as a binary tree with links back to its root."""
    from pyspark.sql import Window

    f = table(spark, d, "fetched").select("crawl_id", "url").distinct().where("crawl_id is not null")
    n = f.withColumn("n", F.row_number().over(Window.partitionBy("crawl_id").orderBy("url")))
    a = n.select(F.col("crawl_id").alias("crawl"), F.col("url").alias("source"), F.explode(F.array(F.col("n") * 2, F.col("n") * 2 + 1, F.lit(1))).alias("m"))
    b = n.select(F.col("crawl_id").alias("crawl"), F.col("url").alias("target"), F.col("n").alias("m"))
    links = a.join(b, ["crawl", "m"]).select("crawl", "source", F.col("m").alias("ordinal"), "target")
    return W.breadth_first(n.where("n = 1").select(F.col("crawl_id").alias("crawl"), F.col("url").alias("page")), links)


@R.add(
    r"""WITH c AS (SELECT DISTINCT ON (crawl_id) crawl_id, start_url FROM crawl_stats), f AS (SELECT DISTINCT crawl_id, url FROM fetched), j AS (SELECT crawl_id, url, lower(regexp_extract(start_url, '^([a-zA-Z]+://[^/?#]*)', 1)) = lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) AS same,
      coalesce(nullif(regexp_extract(start_url, '^[a-zA-Z]+://[^/?#]*(.*/)', 1), ''), '/') AS dir, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS p FROM f JOIN c USING (crawl_id))
    SELECT crawl_id, count(DISTINCT CASE WHEN same AND NOT starts_with(p, dir) AND NOT regexp_matches(lower(p), '\.(?:"""
    + "|".join(U.NOT_A_PAGE)
    + r""")/*$') THEN regexp_replace(url, '#.*$', '') END) AS outside FROM j GROUP BY crawl_id"""
)
def outside_prefix(spark: SparkSession, d: str) -> DataFrame:
    start = one_per_key(table(spark, d, "crawl_stats").select("crawl_id", U.parse(F.col("start_url")).alias("start")), "crawl_id")
    rows = table(spark, d, "fetched").select("crawl_id", U.parse(F.col("url")).alias("target")).distinct().join(start, "crawl_id")
    return W.outside_prefix(rows, "crawl_id")


@R.add(
    """WITH f AS (SELECT DISTINCT crawl_id, url FROM fetched) SELECT crawl_id, 'map' AS kind, url AS seed FROM f UNION ALL SELECT crawl_id, 'index', url FROM f WHERE NOT contains(url, ')')"""
)
def seeds(spark: SparkSession, d: str) -> DataFrame:
    """A sitemap and a Markdown index for each page, and read again."""
    site = table(spark, d, "fetched").select("crawl_id", "url").distinct().withColumn("u", F.array("url"))
    xml = F.concat(F.lit("<urlset>"), F.array_join(F.transform("u", lambda x: F.concat(F.lit("<url><loc> \n"), x, F.lit("\n</LOC></url>"))), ""), F.lit("</urlset>"))
    index = F.array_join(F.transform("u", lambda x: F.concat(F.lit("- [page]("), x, F.lit(")"))), "\n")
    both = site.select("crawl_id", F.explode(F.array(F.struct(F.lit("map").alias("kind"), W.seeds_of_sitemap(xml).alias("s")), F.struct(F.lit("index").alias("kind"), W.seeds_of_index(index).alias("s")))).alias("k"))
    return both.select("crawl_id", "k.kind", F.explode("k.s").alias("seed"))


@R.add("SELECT crawl_id, count(*) AS pages, count(DISTINCT url) AS addresses, min(fetched_at)::DATE::VARCHAR AS first_day, max(fetched_at)::DATE::VARCHAR AS last_day FROM (SELECT DISTINCT fetch_id, crawl_id, url, fetched_at FROM fetched) GROUP BY crawl_id")
def crawl_summary(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fetched").select("fetch_id", "crawl_id", "url", "fetched_at").distinct()
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return f.groupBy("crawl_id").agg(F.count("*").alias("pages"), F.count_distinct("url").alias("addresses"), day(F.min("fetched_at")).alias("first_day"), day(F.max("fetched_at")).alias("last_day"))


# snapshots


_KEY = "CASE WHEN origin IS NULL OR origin = path THEN path ELSE origin || ' ' || path END"
_SNAP = f"""{_F}, cut AS (SELECT min(extracted_at) + (max(extracted_at) - min(extracted_at)) / 2 AS t FROM f),
  b AS (SELECT DISTINCT ON (key) * FROM (SELECT {_KEY} AS key, content_hash, estimated_tokens, extracted_at, file_id FROM f, cut WHERE extracted_at <= t) ORDER BY key, extracted_at DESC, file_id DESC),
  a AS (SELECT DISTINCT ON (key) * FROM (SELECT {_KEY} AS key, content_hash, estimated_tokens, extracted_at, file_id FROM f) ORDER BY key, extracted_at DESC, file_id DESC),
  c AS (SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'added' WHEN a.key IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (key) WHERE a.key IS NULL OR b.key IS NULL OR a.content_hash IS DISTINCT FROM b.content_hash)"""


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The sources as read by half time, and at the end."""
    f = _reports(spark, d).select("file_id", N.identity(F.col("origin"), F.col("path")).alias("key"), "content_hash", "estimated_tokens", "extracted_at")
    ends = f.agg(F.min("extracted_at").alias("lo"), F.max("extracted_at").alias("hi")).select((F.col("lo") + (F.col("hi") - F.col("lo")) / 2).alias("t"))

    def last(rows: DataFrame) -> DataFrame:
        newest = F.max_by(F.struct("content_hash", "estimated_tokens"), F.struct("extracted_at", "file_id"))
        return rows.groupBy("key").agg(newest.alias("v")).select("key", "v.content_hash", "v.estimated_tokens")

    # one row with the time that divides them
    return last(f.join(ends, F.col("extracted_at") <= F.col("t"), "left_semi")), last(f)


@R.add(f"WITH {_SNAP} SELECT key, change FROM c")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return N.changes(*_snapshots(spark, d))


@R.add(
    f"""WITH {_SNAP} SELECT (SELECT CAST(sum(estimated_tokens) AS BIGINT) FROM b) AS was_tokens, (SELECT CAST(sum(estimated_tokens) AS BIGINT) FROM a) AS now_tokens, count(*) FILTER (change = 'added') AS added,
    count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'changed') AS changed, count(*) > 0 AS moved FROM c"""
)
def snapshot_summary(spark: SparkSession, d: str) -> DataFrame:
    return N.summary(*_snapshots(spark, d))


@R.add(f"WITH {_SNAP}, n AS (SELECT change, key, row_number() OVER (PARTITION BY change ORDER BY key) AS place FROM c) SELECT change, place, key FROM n WHERE place <= 20 UNION ALL SELECT change, 21, '... and ' || (count(*) - 20) || ' more' FROM c GROUP BY change HAVING count(*) > 20")
def snapshot_shown(spark: SparkSession, d: str) -> DataFrame:
    return N.shown(N.changes(*_snapshots(spark, d)))


# examinations


_LINES = "string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10))"


@R.add(
    f"""WITH x AS (SELECT doc_id, {_LINES} AS l FROM documents WHERE text <> ''), l AS (SELECT doc_id, (ceil(len(l) / 4.0))::BIGINT AS stride, unnest(l) AS raw, generate_subscripts(l, 1) AS n FROM x),
    t AS (SELECT doc_id, (n - 1) // stride AS part, n, CASE WHEN right(raw, 1) = chr(13) THEN left(raw, length(raw) - 1) ELSE raw END AS line FROM l),
    c AS (SELECT *, len(regexp_extract_all(regexp_replace(line, '[<CJK>]', ' ', 'g'), '[^<WS>]+')) AS words, len(regexp_extract_all(line, '[<CJK>]')) AS wide FROM t),
    s AS (SELECT *, coalesce(sum(words) OVER w, 0) AS before_words, coalesce(sum(wide) OVER w, 0) AS before_wide FROM c WINDOW w AS (PARTITION BY doc_id, part ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    e AS (SELECT doc_id, part, string_agg(line || chr(10), '' ORDER BY n) AS excerpt FROM s WHERE floor(before_words / 0.75 + before_wide / 1.5) <= {E.EXCERPT_TOKENS} GROUP BY doc_id, part)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) AS excerpt_no, md5(excerpt) AS excerpt FROM e WHERE regexp_matches(excerpt, '[^<WS>]')"""
)
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Four excerpts of each document."""
    return E.excerpts(table(spark, d, "documents"), "doc_id", 4).select("doc_id", "excerpt_no", F.md5("excerpt").alias("excerpt"))


@R.add(
    r"""SELECT chunk_id, CASE WHEN strpos(r, '[') > 0 AND length(r) - strpos(reverse(r), ']') + 1 > strpos(r, '[') AND contains(r, ']') THEN substr(r, strpos(r, '['), length(r) - strpos(reverse(r), ']') + 2 - strpos(r, '[')) END AS json FROM
    (SELECT DISTINCT chunk_id, CASE WHEN chunk_id % 4 = 0 THEN title ELSE 'Sure: [{"question": "' || replace(title, '"', '') || '"}, {"n": [1]}] done' END AS r FROM chunks)"""
)
def exam_json(spark: SparkSession, d: str) -> DataFrame:
    quoted = F.concat(F.lit('Sure: [{"question": "'), F.replace("title", F.lit('"'), F.lit("")), F.lit('"}, {"n": [1]}] done'))
    reply = F.when(F.col("chunk_id") % 4 == 0, F.col("title")).otherwise(quoted)
    return table(spark, d, "chunks").select("chunk_id", E.json_array(reply).alias("json")).distinct()


_REPLY = "'1: PASS — ' || dir_name || chr(10) || '#2: fail - no value - ' || skill_id || chr(10) || 'x: PASS' || chr(10) || '9: PASS' || chr(10) || CASE WHEN skill_id % 3 = 0 THEN ' 3 : Passed' || chr(10) || '2: PASS — later' ELSE '3. PASS' END"


def _graded(spark: SparkSession, d: str) -> DataFrame:
    s = one_per_key(table(spark, d, "skills").select("skill_id", "dir_name"), "skill_id")
    return E.grades(s.select("skill_id", F.expr(_REPLY.replace("chr(10)", "char(10)")).alias("reply"), F.lit(4).alias("n")), "skill_id", "reply", "n")


_GRADES = """s AS (SELECT DISTINCT skill_id, dir_name FROM skills), g AS (SELECT skill_id, unnest([1, 2, 3, 4]) AS ordinal, dir_name FROM s),
  v AS (SELECT skill_id, ordinal, ordinal = 1 OR (skill_id % 3 = 0 AND ordinal IN (2, 3)) AS passed,
  CASE WHEN ordinal = 1 THEN dir_name WHEN ordinal = 2 AND skill_id % 3 = 0 THEN 'later' WHEN ordinal = 2 THEN 'no value - ' || skill_id WHEN ordinal = 3 AND skill_id % 3 = 0 THEN '' ELSE 'no grade given' END AS reason FROM g)"""


@R.add(f"WITH {_GRADES} SELECT skill_id, ordinal, passed, reason FROM v")
def exam_grades(spark: SparkSession, d: str) -> DataFrame:
    return _graded(spark, d)


@R.add(
    f"""WITH {_GRADES} SELECT skill_id, count(*) AS questions, count(*) FILTER (passed) AS passed, count(*) FILTER (passed) / count(*)::DOUBLE AS pass_rate,
    coalesce(string_agg(DISTINCT 'part ' || ordinal % 2, ',' ORDER BY 'part ' || ordinal % 2) FILTER (NOT passed AND ordinal <> 4), '') AS weak FROM v GROUP BY skill_id"""
)
def exam_report(spark: SparkSession, d: str) -> DataFrame:
    graded = _graded(spark, d).withColumn("section", F.when(F.col("ordinal") != 4, F.concat(F.lit("part "), (F.col("ordinal") % 2).cast("string"))).otherwise(" "))
    return E.report(graded, "skill_id").select("skill_id", "questions", "passed", "pass_rate", F.array_join("weak_sections", ",").alias("weak"))


@R.add(
    """SELECT DISTINCT skill_id, CASE skill_id % 3 WHEN 0 THEN 'limit of ' || dir_name WHEN 1 THEN left(dir_name || ' is down', 300) ELSE 'no message' END AS message FROM skills"""
)
def api_error_message(spark: SparkSession, d: str) -> DataFrame:
    body = F.when(F.col("skill_id") % 3 == 0, F.to_json(F.struct(F.struct(F.concat(F.lit("limit of "), "dir_name").alias("message")).alias("error")))).when(F.col("skill_id") % 3 == 1, F.concat("dir_name", F.lit(" is down "))).otherwise(" ")
    return table(spark, d, "skills").select("skill_id", E.api_error_message(body).alias("message")).distinct()
