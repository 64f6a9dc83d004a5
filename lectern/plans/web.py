"""Queries on HTML and URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import html as H
from lectern.functions import text as T
from lectern.functions import urls as U
from lectern.plans.base import Registry
from lectern.plans.texts import _BARE
from lectern.sources.tables import one_per_key, table

R = Registry()

_NAMED = "{0}"
for _name, _sign in H.NAMED:
    _NAMED = f"replace({_NAMED}, '{_name}', '{_sign.replace(chr(39), chr(39) * 2)}')"


def _decode(x: str) -> str:
    named = _NAMED.format(x)
    numeric = (
        f"CASE WHEN contains({named}, '&#') THEN array_to_string(list_transform(list_zip(regexp_split_to_array({named}, '&#[xX]?[0-9A-Fa-f]+;'), regexp_extract_all({named}, '&#[xX]?[0-9A-Fa-f]+;')), "
        "lambda z: coalesce(z[1], '') || coalesce(CASE WHEN z[2] LIKE '&#x%' THEN chr(('0x' || regexp_extract(z[2], '&#x([0-9A-Fa-f]+);', 1))::INT) "
        "WHEN regexp_matches(z[2], '^&#[0-9]+;$') THEN chr(regexp_extract(z[2], '&#([0-9]+);', 1)::INT) ELSE z[2] END, '')), '') "
        f"ELSE {named} END"
    )
    return f"replace(replace({numeric}, '¶', ''), '&amp;', '&')"


def _strip(x: str) -> str:
    pre = r"(?is)<pre\b[^>]*>(.*?)</\s*pre\s*>"
    code = f"regexp_replace(regexp_replace({_decode('''regexp_replace(p, '(?s)<[^>]+>', '', 'g')''')}, '^\\n+', ''), '[<WS>]+$', '')"
    codes = f"list_transform(regexp_extract_all({x}, '{pre}', 1), lambda p: CASE WHEN {code} = '' THEN '' ELSE '```' || chr(10) || {code} || chr(10) || '```' END)"
    t = f"regexp_replace({x}, '{pre}', chr(10) || '\ue000' || chr(10), 'g')"
    t = f"regexp_replace({t}, '(?s)<!--.*?-->', ' ', 'g')"
    t = rf"regexp_replace({t}, '(?is)<(?:script|style)\b[^>]*>.*?</\s*(?:script|style)\s*>', ' ', 'g')"
    t = rf"regexp_replace({t}, '(?i)</\s*(?:p|div|section|article|li|tr|h[1-6]|blockquote|pre)\s*>|<\s*br\s*/?>', chr(10), 'g')"
    t = _decode(f"regexp_replace({t}, '(?s)<[^>]+>', '', 'g')")
    t = f"regexp_replace({t}, '[<LINE_WS>]*\\n[<LINE_WS>]*', chr(10), 'g')"
    t = _BARE.format(f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')")
    return f"array_to_string(list_transform(list_zip(string_split({t}, '\ue000'), {codes}), lambda z: coalesce(z[1], '') || coalesce(z[2], '')), '')"


_LINE_WS = r"\x{9}\x{B}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


@R.add(f"SELECT DISTINCT file_id, md5({_strip('text')}) AS stripped FROM extractions".replace("<LINE_WS>", _LINE_WS))
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extractions").select("file_id", F.md5(H.strip(F.col("text"))).alias("stripped")).distinct()


@R.add(f"SELECT DISTINCT file_id, md5({_decode('text')}) AS decoded FROM extractions")
def html_entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extractions").select("file_id", F.md5(H.decode_entities(F.col("text"))).alias("decoded")).distinct()


_HREF = r"""regexp_extract_all({0}, '(?is)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', 1)"""


@R.add(f"""SELECT file_id, n AS link_no, trim(h, '"''') AS href FROM (SELECT file_id, unnest(l) AS h, generate_subscripts(l, 1) AS n FROM (SELECT DISTINCT file_id, {_HREF.format('text')} AS l FROM extractions))""")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extractions").select("file_id", H.links(F.col("text")).alias("l")).distinct()
    return rows.select("file_id", F.posexplode("l").alias("n", "href")).select("file_id", (F.col("n") + 1).cast("bigint").alias("link_no"), "href")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """HTML answers as text, repeated rows included: declared as HTML, or undeclared with the address of a page.

    Copies are dropped from what is made of them, so that whole pages aren't shuffled.
    """
    f = table(spark, d, "fetched")
    ext = U.extension(U.parse(F.col("url")))
    kind = F.lower("content_type")
    page = F.when(kind.isNotNull(), F.contains(kind, F.lit("html"))).otherwise(ext.isNull() | ext.isin("html", "htm", "xhtml"))
    return f.where(page).select("fetch_id", "url", T.lossy(F.col("bytes")).alias("html"))


# pages built from chunks: all of it valid text, in elements whose place is known

_SAFE = "coalesce(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '')"
_ARTICLE = f"""'<article><h1>' || {_SAFE.format('title')} || '</h1><pre class="c">' || substr({_SAFE.format('title')}, 1, 20) || '<NL>  x &lt; y</pre><p>' || {_SAFE.format('text')} || '</p>' || '{{0}}' || '</article>'"""
_HEAD = f"""'<!doctype html><html><head>' || CASE WHEN chunk_id % 3 = 0 THEN '<TITLE lang=x> ' || {_SAFE.format('title')} || ' </TITLE>' ELSE '' END || '<style>p {{}}</style></head>'"""
_PAGE = f"""{_HEAD} || '<body class="x"><nav><ul><li><a href="/a">Menu</a></li></ul></nav>' || {_ARTICLE.format('<div class="sidebar-left"><div>aside</div></div>')} || '<p>after</p><footer>foot</footer></body></html>'"""
_URL = "'https://h.example/p/' || chunk_id"


def _built(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", F.expr(_URL).alias("url"), F.expr(_PAGE.replace("<NL>", "\\n")).alias("html"))


_BUILT = "b AS (SELECT DISTINCT chunk_id, {0} AS html, title FROM chunks), s AS (SELECT chunk_id, title, {1} AS t, html FROM b)"
_CONTENT = (
    "c AS (SELECT DISTINCT chunk_id, title, {0} AS article FROM chunks), l AS (SELECT *, '<body class=\"x\">' || chr(10) || article || '<p>after</p>' || chr(10) || '</body>' AS body FROM c), "
    "m AS (SELECT chunk_id, title, {1} AS short, {2} AS whole FROM l), n AS (SELECT chunk_id, title, CASE WHEN length(short) >= 200 THEN short ELSE whole END AS t FROM m)"
).format(_ARTICLE.format("<NL>").replace("'<NL>'", "chr(10)"), _strip("article"), _strip("body"))
_NAME = "nullif({0}, '')".format(_BARE.format("regexp_replace(coalesce(title, ''), '[<WS>]+', ' ', 'g')"))


def _lined(sql: str) -> str:
    return sql.replace("<NL>", "' || chr(10) || '").replace("<LINE_WS>", _LINE_WS)


@R.add(_lined(f"WITH {_BUILT.format(_PAGE, _strip('html'))} SELECT chunk_id, md5(t) AS stripped FROM s"))
def html_code_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Pages with a code block each, stripped: the block stays as it is, fenced."""
    return _built(spark, d).select("chunk_id", F.md5(H.strip(F.col("html"))).alias("stripped")).distinct()


@R.add(f"SELECT DISTINCT chunk_id, {_NAME} AS title FROM chunks")
def html_title_built(spark: SparkSession, d: str) -> DataFrame:
    """Titles of pages that have a title element or only a heading."""
    return _built(spark, d).select("chunk_id", H.title(F.col("html")).alias("title")).distinct()


@R.add(_lined(f"WITH {_CONTENT} SELECT chunk_id, md5(t) AS text FROM n"))
def html_content_built(spark: SparkSession, d: str) -> DataFrame:
    """The content of pages: the article, or the whole body where that is a stub, without what surrounds it."""
    return _built(spark, d).select("chunk_id", F.md5(H.main_content("html")).alias("text")).distinct()


@R.add(_lined(f"WITH {_CONTENT} SELECT chunk_id, md5('# ' || coalesce({_NAME}, '/p/' || chunk_id) || chr(10) || chr(10) || 'source: ' || {_URL} || chr(10) || chr(10) || t) AS text FROM n"))
def page_text_built(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d).select("chunk_id", F.md5(T.page_header(H.title(F.col("html")), F.col("url"), H.main_content("html"))).alias("text")).distinct()


@R.add()
def html_title(spark: SparkSession, d: str) -> DataFrame:
    """Over bytes that aren't all UTF-8, which the SQL engine can't decode; tested against the Python model."""
    return _pages(spark, d).select("fetch_id", H.title(F.col("html")).alias("title")).distinct()


@R.add()
def html_main_content(spark: SparkSession, d: str) -> DataFrame:
    """Balanced elements aren't regular; tested against page fixtures."""
    return one_per_key(_pages(spark, d).select("fetch_id", H.main_content("html").alias("text")), "fetch_id")


@R.add()
def page_text(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d).select("fetch_id", "url", H.title(F.col("html")).alias("title"), H.main_content("html").alias("body"))
    return one_per_key(pages.select("fetch_id", T.page_header(F.col("title"), F.col("url"), F.col("body")).alias("text")), "fetch_id")


@R.add()
def run_report_by_host(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: what a crawl read, by host: pages, characters, tokens, invisible code points, distinct texts; the ten largest."""
    pages = _pages(spark, d).select("fetch_id", U.parse(F.col("url"))["host"].alias("host"), H.strip(F.col("html")).alias("t"))
    facts = pages.select("fetch_id", "host", F.char_length("t").alias("all"), T.sanitize(F.col("t")).alias("clean"))
    facts = one_per_key(facts.select("fetch_id", "host", (F.col("all") - F.char_length("clean")).alias("removed"), F.char_length("clean").alias("n"), T.estimate_tokens(F.col("clean")).alias("k"), F.xxhash64("clean").alias("h")), "fetch_id")
    by = facts.groupBy("host").agg(F.count("*").alias("pages"), F.sum("n").alias("characters"), F.sum("k").alias("tokens"), F.sum("removed").alias("removed"), F.count_distinct("h").alias("texts"))
    return by.orderBy(F.col("tokens").desc(), "host").limit(10)


_PARSED = r"""u AS (SELECT DISTINCT fetch_id, url, lower(regexp_extract(url, '^(.*?)://', 1)) AS scheme, regexp_replace(regexp_extract(url, '^.*?://([^/?#]*)', 1), '^.*@', '') AS a,
  regexp_extract(url, '^.*?://[^/?#]*([^#]*)', 1) AS tail FROM fetched),
 v AS (SELECT fetch_id, url, scheme, lower(regexp_replace(a, ':[^:]*$', '')) AS host, TRY_CAST(nullif(regexp_extract(a, ':([0-9]+)$', 1), '') AS INT) AS port,
  CASE WHEN regexp_extract(tail, '^([^?]*)', 1) = '' THEN '/' ELSE regexp_extract(tail, '^([^?]*)', 1) END AS raw_path, nullif(regexp_extract(tail, '^[^?]*\?(.+)$', 1), '') AS query FROM u)"""


def _norm(p: str) -> str:
    kept = f"list_reduce(list_transform(string_split({p}, '/'), lambda s: [s]), lambda a, b: CASE WHEN b[1] IN ('', '.') THEN a WHEN b[1] = '..' THEN a[1:len(a) - 1] ELSE list_concat(a, b) END, []::VARCHAR[])"
    joined = f"('/' || array_to_string({kept}, '/'))"
    return f"CASE WHEN {p} LIKE '%/' AND length({p}) > 1 AND {joined} NOT LIKE '%/' THEN {joined} || '/' ELSE {joined} END"


@R.add(f"WITH {_PARSED} SELECT fetch_id, scheme, host, port, {_norm('raw_path')} AS path, query FROM v")
def url_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetched").select("fetch_id", U.parse(F.col("url")).alias("u")).distinct().select("fetch_id", "u.*")


@R.add(f"WITH {_PARSED}, w AS (SELECT fetch_id, raw_path || '/./x//../y/../../z/' AS p FROM v) SELECT fetch_id, {_norm('p')} AS path FROM w")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    dotted = F.concat(F.regexp_extract(F.col("url"), r"^[a-z]+://[^/?#]*([^?#]*)", 1), F.lit("/./x//../y/../../z/"))
    return table(spark, d, "fetched").select("fetch_id", U.normalize_path(F.regexp_replace(dotted, "^//", "//")).alias("path")).distinct()


#: Shapes a link can have; each is tried on every page.
_SHAPES = ("../up", "next.html#part", "?q=1", "/root/page", "//other.example/a/../b", "https://abs.example:8443/x", "mailto:a@b.example", "tel:123", "#top", " sub/./page ", "ftp://files.example/x", "https://bad.example:99999/")


def _joined(spark: SparkSession, d: str) -> DataFrame:
    """Every page with every shape, a fixed dozen."""
    shapes = F.array(*[F.struct(F.lit(i).alias("shape"), F.lit(s).alias("href")) for i, s in enumerate(_SHAPES)])
    base = table(spark, d, "fetched").select("fetch_id", "url").distinct()
    return base.select("fetch_id", U.parse(F.col("url")).alias("u"), F.inline(shapes))


_DIR = "regexp_extract({0}, '^(.*/)', 1)"


@R.add(
    f"""WITH {_PARSED}, n AS (SELECT fetch_id, scheme, host, port, {_norm('raw_path')} AS path FROM v), o AS (SELECT *, scheme || '://' || host || coalesce(':' || port, '') AS origin FROM n),
  j AS (SELECT fetch_id, 0 AS shape, origin || {_norm("(" + _DIR.format("path") + " || '../up')")} AS target FROM o
  UNION ALL SELECT fetch_id, 1, origin || {_norm("(" + _DIR.format("path") + " || 'next.html')")} FROM o UNION ALL SELECT fetch_id, 2, origin || path || '?q=1' FROM o UNION ALL SELECT fetch_id, 3, origin || '/root/page' FROM o
  UNION ALL SELECT fetch_id, 4, scheme || '://other.example/b' FROM o UNION ALL SELECT fetch_id, 5, 'https://abs.example:8443/x' FROM o UNION ALL SELECT fetch_id, unnest([6, 7, 8, 10, 11]), NULL FROM o
  UNION ALL SELECT fetch_id, 9, origin || {_norm("(" + _DIR.format("path") + " || 'sub/./page')")} FROM o) SELECT fetch_id, shape, target FROM j"""
)
def url_join(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d).select("fetch_id", "shape", U.render(U.join(F.col("u"), F.col("href"))).alias("target"))


@R.add(
    f"""WITH {_PARSED}, s AS (SELECT DISTINCT crawl_id, lower(regexp_extract(start_url, '^(.*?)://', 1)) AS scheme, lower(regexp_extract(start_url, '^.*?://([^/?#]*)', 1)) AS host, regexp_extract(start_url, '^.*?://[^/?#]*(/[^?#]*/|/)', 1) AS dir FROM crawl_stats),
  f AS (SELECT DISTINCT fetch_id, crawl_id FROM fetched)
  SELECT fetch_id, coalesce(v.scheme = s.scheme AND lower(v.host || coalesce(':' || v.port, '')) = s.host, false) AS same_origin,
  coalesce(v.scheme = s.scheme AND lower(v.host || coalesce(':' || v.port, '')) = s.host AND starts_with(v.raw_path, CASE WHEN s.dir = '' THEN '/' ELSE s.dir END)
   AND NOT regexp_matches(lower(v.raw_path), '\\.(?:{'|'.join(U.NOT_A_PAGE)})$'), false) AS follow
  FROM v JOIN f USING (fetch_id) JOIN s USING (crawl_id)"""
)
def follow_links(spark: SparkSession, d: str) -> DataFrame:
    """Which pages a crawl may follow: same origin as its start, under its directory, no asset."""
    start = one_per_key(table(spark, d, "crawl_stats").select("crawl_id", U.parse(F.col("start_url")).alias("s")), "crawl_id")
    f = table(spark, d, "fetched").select("fetch_id", "crawl_id", U.parse(F.col("url")).alias("u")).distinct().join(start, "crawl_id")
    return f.select("fetch_id", F.coalesce(U.same_origin(F.col("u"), F.col("s")), F.lit(False)).alias("same_origin"), F.coalesce(U.worth_following(F.col("u"), F.col("s")), F.lit(False)).alias("follow"))


@R.add(
    f"""WITH {_PARSED} SELECT fetch_id, scheme || '://' || host || coalesce(':' || port, '') || {_norm('raw_path')} || CASE WHEN query IS NULL OR raw_path LIKE '%/' OR regexp_matches(lower(raw_path), '\\.(?:html|htm|xhtml|md|txt|pdf)$') THEN '' ELSE '?' || query END AS url FROM v"""
)
def decorative_query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetched").select("fetch_id", U.render(U.without_decoration(U.parse(F.col("url")))).alias("url")).distinct()


@R.add(
    f"""WITH {_PARSED} SELECT fetch_id, nullif(lower(regexp_extract(raw_path, '\\.([A-Za-z0-9]+)/*$', 1)), '') AS ext, NOT regexp_matches(lower(raw_path), '\\.(?:{'|'.join(U.NOT_A_PAGE)})/*$') AS page,
  nullif(regexp_extract(regexp_replace({_norm('raw_path')}, '/+$', ''), '^(.*/)', 1), '') AS parent FROM v"""
)
def asset_filter(spark: SparkSession, d: str) -> DataFrame:
    u = U.parse(F.col("url"))
    return table(spark, d, "fetched").select("fetch_id", U.extension(u).alias("ext"), U.looks_like_a_page(u).alias("page"), U.parent(u["path"]).alias("parent")).distinct()


@R.add(f"WITH {_PARSED}, c AS (SELECT DISTINCT fetch_id, octet_length(bytes) AS n FROM fetched) SELECT host, count(*) AS pages, CAST(sum(n) AS BIGINT) AS bytes FROM v JOIN c USING (fetch_id) GROUP BY host")
def bytes_by_host(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "fetched").select("fetch_id", U.parse(F.col("url"))["host"].alias("host"), F.octet_length("bytes").alias("n")).distinct()
    return rows.groupBy("host").agg(F.count("*").alias("pages"), F.sum("n").alias("bytes"))
