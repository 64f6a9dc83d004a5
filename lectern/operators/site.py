"""Reading a site: its pages from a table of answers, walked from a start, cut to their content, with what there is to say of the walk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import html as H
from lectern.functions import text as T
from lectern.functions import urls as U
from lectern.operators import crawl as W
from lectern.operators.sources import is_html
from lectern.sources.tables import stored

LISTED = 20


def page_links(pages: DataFrame, starts: DataFrame) -> DataFrame:
    """(crawl, source, ordinal, target, follow, beside): where the pages of each crawl lead, decoration aside, and whether that is under or beside the start's folder.

    Pages are (crawl, url, html), starts (crawl, start).  Stored, as a walk goes over it again and again.
    """
    rows = pages.join(starts.select("crawl", U.parse(F.col("start")).alias("_s")), "crawl").select("crawl", "url", "_s", U.parse(F.col("url")).alias("_u"), F.posexplode(H.links(F.col("html"))).alias("ordinal", "_h"))
    joined = rows.withColumn("_t", U.without_decoration(U.join(F.col("_u"), F.col("_h")))).where("_t IS NOT NULL")
    kind = (U.worth_following(F.col("_t"), F.col("_s")).alias("follow"), U.beside(F.col("_t"), F.col("_s")).alias("beside"))
    return stored(joined.select("crawl", F.col("url").alias("source"), "ordinal", U.render(F.col("_t")).alias("target"), *kind))


def crawl_site(answers: DataFrame, starts: DataFrame, robots: DataFrame | None = None, depth: int = W.DEPTH, most: int = W.MOST_PAGES, seeds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, statistics) of crawls over answers (crawl, url, content_type, bytes) from starts (crawl, start).

    documents: crawl, place, url, depth, method, text; a page is cut to its content
    under a header with its title and address, other answers keep their text for readers of files (null here).
    statistics, one row per crawl: pages_fetched, skipped_by_robots, outside_prefix, hit_page_limit.
    An address that isn't among the answers could not be fetched and takes no place.
    robots is (origin, body); without it everything is allowed.  seeds (crawl, target, ordinal) are
    followed from the start, as if its page linked to them.
    """
    most = max(1, most)
    at = U.render(U.without_decoration(U.parse(F.col("url"))))
    known = stored(answers.select("crawl", at.alias("url"), "content_type", "bytes").where("url IS NOT NULL").dropDuplicates(["crawl", "url"]))
    page = is_html(F.col("content_type"), F.col("url"))
    pages = known.where(page).select("crawl", "url", T.lossy(F.col("bytes")).alias("html"))
    linked = page_links(pages, starts)
    beside = linked.groupBy("crawl").agg(F.count_distinct(F.when(F.col("beside"), F.col("target"))).alias("outside_prefix"))
    follow = linked.where("follow").select("crawl", "source", "ordinal", "target")
    if seeds is not None:
        home = starts.select("crawl", U.render(U.without_decoration(U.parse(F.col("start")))).alias("source"))
        follow = follow.unionByName(seeds.select("crawl", "target", "ordinal").join(home, "crawl").select("crawl", "source", "ordinal", "target"))
    follow = follow.join(known.select("crawl", F.col("url").alias("target")), ["crawl", "target"], "left_semi")
    begin = starts.select("crawl", U.render(U.without_decoration(U.parse(F.col("start")))).alias("page"))
    refused = begin.select("crawl", F.lit(0).cast("bigint").alias("skipped_by_robots")).limit(0)
    if robots is not None:
        every = follow.select("crawl", "target").unionByName(begin.select("crawl", F.col("page").alias("target"))).distinct().withColumn("_u", U.parse(F.col("target")))
        keyed = every.select(F.to_json(F.struct("crawl", "target")).alias("key"), U.origin(F.col("_u")).alias("origin"), F.col("_u.path").alias("path"))
        verdict = W.robots_allow(keyed, robots, "key")
        judged = every.select("crawl", "target", F.to_json(F.struct("crawl", "target")).alias("key")).join(verdict, "key").select("crawl", "target", "allowed")
        refused = judged.where("NOT allowed").groupBy("crawl").agg(F.count("*").alias("skipped_by_robots"))
        good = judged.where("allowed").select("crawl", "target")
        follow = follow.join(good, ["crawl", "target"], "left_semi")
        begin = begin.join(good.withColumnRenamed("target", "page"), ["crawl", "page"], "left_semi")
    walked = W.breadth_first(begin, follow, depth, most)
    read = walked.withColumnRenamed("page", "url").join(known, ["crawl", "url"])
    markup = F.when(is_html(F.col("content_type"), F.col("url")), T.lossy(F.col("bytes")))
    body = read.select("crawl", "place", "url", "depth", markup.alias("html")).select("crawl", "place", "url", "depth", H.title(F.col("html")).alias("title"), H.main_content("html").alias("body"))
    documents = body.select("crawl", "place", "url", "depth", F.when(F.col("body").isNotNull(), "web-page").alias("method"), T.page_header(F.col("title"), F.col("url"), F.col("body")).alias("text"))
    fetched = walked.groupBy("crawl").agg(F.count("*").alias("pages_fetched"))
    statistics = starts.select("crawl").join(fetched, "crawl", "left").join(refused, "crawl", "left").join(beside, "crawl", "left").fillna(0)
    # a level is cut at the limit, so what lies beyond it shows as the limit being reached
    return documents, statistics.withColumn("hit_page_limit", F.col("pages_fetched") >= most)


def notes(statistics: DataFrame) -> DataFrame:
    """(crawl, ordinal, note): what a reader should know of a walk."""
    said = F.array(
        F.when(F.col("pages_fetched") == 0, "no page could be read"),
        F.when(F.col("skipped_by_robots") > 0, F.concat(F.col("skipped_by_robots").cast("string"), F.lit(" pages are closed to crawlers"))),
        F.when(F.col("outside_prefix") > 0, F.concat(F.col("outside_prefix").cast("string"), F.lit(" pages lie outside the folder of the start"))),
        F.when(F.col("hit_page_limit"), F.concat(F.lit("stopped at the limit of pages: "), F.col("pages_fetched").cast("string"))),
    )
    return statistics.select("crawl", F.posexplode(F.array_compact(said)).alias("ordinal", "note"))
