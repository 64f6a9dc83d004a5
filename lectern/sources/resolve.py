"""From source strings to documents: files and folders, pages, sites and repositories as one table, with what there is to say of each.

A source that can't be read is a row with an error, never the end of the run.  The driver holds
source strings, and of a site the addresses within its limit of pages; answers,
links and documents stay tables.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import html as H
from lectern.functions import text as T
from lectern.functions import urls as U
from lectern.operators import crawl as W
from lectern.operators import site as S
from lectern.operators import sources as C
from lectern.sources.locks import Options
from lectern.sources.readers import Reader, read_files, read_rows
from lectern.sources.remote import checkout, read_checkout, read_urls
from lectern.sources.tables import shared_folder, stored

#: Columns of a document: what it is called, where it came from, where it lies here, what it says, why not.
DOCUMENT = "source string, kind string, path string, origin string, local_path string, method string, text string, pages_needing_ocr array<int>, error string"
#: Where a site may have all of its text, its list of pages, its map and its rules.
WHOLE, INDEX, MAP, RULES = ("llms-full.txt", "llms_full.txt"), "llms.txt", "sitemap.xml", "robots.txt"


def _documents(df: DataFrame, source: str, kind: str) -> DataFrame:
    """The frame with the columns of ``DOCUMENT``; those it lacks are null."""
    names = [c.split(" ") for c in DOCUMENT.split(", ")]
    df = df.withColumns({"source": F.lit(source), "kind": F.lit(kind)})
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in names])


def _failure(spark: SparkSession, source: str, kind: str, error: str) -> DataFrame:
    return _documents(spark.createDataFrame([(source, error)], "path string, error string"), source, kind)


def answers_as_documents(answers: DataFrame, pdf: Reader | None = None) -> DataFrame:
    """Documents of answers (url, content_type, bytes, error): pages cut to their content under a header, everything else by its format."""
    page = C.is_html(F.col("content_type"), F.col("url"))
    read = answers.where("error IS NULL")
    markup = read.where(page).select("url", T.lossy(F.col("bytes")).alias("html")).select("url", H.title(F.col("html")).alias("title"), H.main_content("html").alias("body"))
    pages = markup.select(F.col("url").alias("path"), F.col("url").alias("origin"), F.lit("web-page").alias("method"), T.page_header(F.col("title"), F.col("url"), F.col("body")).alias("text"))
    files = read.where(~page).select(F.col("url").alias("path"), C.download_extension(F.col("content_type"), F.col("url")).alias("extension"), F.col("bytes").alias("content"))
    other = read_rows(files, pdf).withColumn("origin", F.col("path"))
    failed = answers.where("error IS NOT NULL").select(F.col("asked").alias("path"), "error")
    return pages.unionByName(other, allowMissingColumns=True).unionByName(failed, allowMissingColumns=True)


def _text(spark: SparkSession, address: str) -> str | None:
    """The text behind one address, if it is plain text."""
    row = read_urls(spark, [address]).where("error IS NULL").select("content_type", T.lossy(F.col("bytes")).alias("text"))
    row = row.where(W.is_plain_text(F.col("content_type"), F.col("text"))).first()
    return row["text"] if row else None


def _values(spark: SparkSession, body: str, expression) -> list[str]:
    return [r[0] for r in spark.createDataFrame([(body,)], "b string").select(F.explode(expression(F.col("b")))).collect()]


def seeds(spark: SparkSession, origin: str, index: bool = True) -> list[str]:
    """What a site says its pages are: its map, at most ``MOST_SITEMAPS`` maps in all, and its list of pages; in that order."""
    out, pending, read = [], [f"{origin}/{MAP}"], 0
    while pending and read < W.MOST_SITEMAPS:
        row = read_urls(spark, [pending.pop()]).where("error IS NULL").select(T.lossy(F.col("bytes")).alias("t")).first()
        if row is None:
            continue
        read += 1
        found = _values(spark, row["t"], W.seeds_of_sitemap)
        if "<sitemapindex" in row["t"]:
            pending += [u for u in found if u.startswith(f"{origin}/")]
        else:
            out += found
    if index and (listed := _text(spark, f"{origin}/{INDEX}")) is not None:
        out += _values(spark, listed, W.seeds_of_index)
    return out


def read_site(spark: SparkSession, start: str, options: Options, pdf: Reader | None = None) -> tuple[DataFrame, list[str]]:
    """(documents, notes) of a walk over a living site: level by level, within its folder, by its rules.

    A start that the site's rules forbid raises ValueError.
    """
    rows = spark.createDataFrame([(0, start)], "crawl int, start string")
    begin = rows.select(U.parse(F.col("start")).alias("u")).select(U.origin(F.col("u")).alias("origin"), U.render(U.without_decoration(F.col("u"))).alias("page"), F.col("u.path").alias("path"), U.directory(F.col("u")).alias("dir")).first()
    if begin["page"] is None:
        raise ValueError("not a URL that can be fetched")
    origin = begin["origin"]
    rules = read_urls(spark, [f"{origin}/{RULES}"]).where("error IS NULL").select(F.lit(origin).alias("origin"), T.lossy(F.col("bytes")).alias("body"))
    rules = stored(rules)
    rule_list = W.robots_rules(next((r["body"] for r in rules.collect()), ""))
    if not W.allowed(rule_list, begin["path"] or "/"):
        raise ValueError(f"{start} is closed to crawlers by the site's {RULES}")
    if not options.no_llms_txt and begin["path"] in {"", "/"}:
        for name in WHOLE:
            if (whole := _text(spark, f"{origin}/{name}")) is not None:
                one = spark.createDataFrame([(f"{origin}/{name}", f"{origin}/{name}", "plain-text", whole)], "path string, origin string, method string, text string")
                return one, [f"{origin}/{name} has the site's whole text and was read instead of its pages"]
    told = spark.createDataFrame([*enumerate(seeds(spark, origin, not options.no_llms_txt))], "n int, u string")
    told = told.select("n", U.join(U.parse(F.lit(start)), F.col("u")).alias("t")).where(F.col("t").isNotNull() & (U.origin(F.col("t")) == F.lit(origin)) & F.startswith(F.col("t.path"), F.lit(begin["dir"])))
    told = stored(told.groupBy(U.render(U.without_decoration(F.col("t"))).alias("target")).agg(F.min("n").alias("n")).select(F.lit(0).alias("crawl"), "target", (F.col("n") - 1_000_000).cast("int").alias("ordinal")))
    # one level of addresses at a time, never more than the limit of pages
    asked: list[str] = []
    frontier, parts = [begin["page"]], []
    for depth in range(options.depth + 1):
        if not frontier:
            break
        asked += frontier
        level = stored(read_urls(spark, frontier, delay_ms=options.delay_ms))
        parts.append(level)
        room = options.max_pages - reduce(lambda n, p: n + p.where("error IS NULL").count(), parts, 0)
        if depth == options.depth or room <= 0:
            break
        html = level.where("error IS NULL").where(C.is_html(F.col("content_type"), F.col("url"))).select(F.lit(0).alias("crawl"), "url", T.lossy(F.col("bytes")).alias("html"))
        order = F.array_position(F.array(*map(F.lit, frontier)), F.col("source"))
        linked = S.page_links(html, rows).where("follow").select("target", F.struct(order, F.col("ordinal")).alias("o"))
        if depth == 0:
            linked = linked.unionByName(told.select("target", F.struct(F.lit(-1).cast("bigint"), F.col("ordinal")).alias("o")))
        new = linked.groupBy("target").agg(F.min("o").alias("o")).where(~F.col("target").isin(asked)).orderBy("o", "target").limit(2 * room + len(asked))
        keyed = [r["target"] for r in new.collect()]
        paths = {r["k"]: r["p"] for r in spark.createDataFrame([(k,) for k in keyed], "k string").select("k", U.parse(F.col("k"))["path"].alias("p")).collect()}
        frontier = [k for k in keyed if W.allowed(rule_list, paths[k] or "/")][:room]
    answers = reduce(DataFrame.unionByName, parts)
    known = answers.where("error IS NULL").select(F.lit(0).alias("crawl"), F.col("asked").alias("url"), "content_type", "bytes")
    documents, statistics = S.crawl_site(known, rows, rules, options.depth, options.max_pages, told)
    documents = stored(documents)
    read = documents.where("text IS NOT NULL").select(F.col("url").alias("path"), F.col("url").alias("origin"), "method", "text")
    # what isn't a page is still of its format
    rest = documents.where("text IS NULL").select("url").join(known, "url").select("url", F.col("url").alias("asked"), "content_type", "bytes", F.lit(None).cast("string").alias("error"))
    notes = [r["note"] for r in S.notes(statistics).orderBy("ordinal").collect()]
    notes += [f"could not read {r['asked']}: {r['error']}" for r in answers.where("error IS NOT NULL").select("asked", "error").collect()]
    return read.unionByName(answers_as_documents(rest, pdf), allowMissingColumns=True), notes


def resolve(spark: SparkSession, inputs: list[str], options: Options | None = None, glob: str | None = None, pdf: Reader | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, notes): documents of all sources as ``DOCUMENT``, in one table; notes are (source, kind, note).

    An existing path is a file or a folder whatever it looks like; `~` is the home folder.  A branch in the options goes before that of the source.
    """
    if not inputs:
        raise ValueError("no sources")
    options = options or Options()
    there = {s.strip() for s in inputs if os.path.exists(os.path.expanduser(s.strip()))}
    listed = spark.createDataFrame([(i, s, s.strip() in there) for i, s in enumerate(inputs)], "i int, raw string, there boolean")
    kinds = listed.select("i", "raw", C.classify(F.col("raw"), F.col("there")).alias("c")).select("i", "raw", "c.*").orderBy("i").collect()
    parts, notes = [], []
    single = [r for r in kinds if r["kind"] == "web" and not options.crawl]
    for r in kinds:
        raw, kind = r["raw"], r["kind"]
        try:
            if kind == "error":
                parts.append(_failure(spark, raw, kind, r["error"]))
            elif kind == "file":
                path = os.path.expanduser(r["url"])
                local = F.regexp_replace("path", r"^file:/*", "/")
                parts.append(_documents(read_files(spark, path, glob, pdf).withColumn("local_path", local), raw, kind))
                parts[-1].schema  # noqa: B018 - a path that isn't there is known here
            elif kind == "repo":
                root = checkout(r["url"], shared_folder(spark).removeprefix("file://"), r["label"], options.branch or r["branch"], r["subdir"])
                docs = read_checkout(spark, root, r["label"], r["url"], options.include, options.exclude, options.max_files)
                dropped = docs.agg(F.max("dropped")).first()[0] or 0
                notes += [(raw, kind, f"{dropped} more files matched than the limit of {options.max_files}")] * (dropped > 0) + [(raw, kind, f"the checkout is at {root}")]
                parts.append(_documents(docs, raw, kind))
            elif options.crawl:
                docs, said = read_site(spark, r["url"], options, pdf)
                notes += [(raw, "site", n) for n in said]
                parts.append(_documents(docs, raw, "site"))
        except Exception as e:  # noqa: BLE001 - one source that fails leaves the others
            parts.append(_failure(spark, raw, kind, str(e).split("\n")[0][:500]))
    if single:
        names = spark.createDataFrame([(r["url"], r["raw"]) for r in single], "asked string, raw string").distinct()
        answers = stored(read_urls(spark, [r["url"] for r in single]).join(names, "asked"))
        docs = answers_as_documents(answers, pdf)
        said = answers.select(F.when(F.col("error").isNull(), F.col("url")).otherwise(F.col("asked")).alias("path"), "raw").distinct()
        parts.append(_documents(docs, "", "page").drop("source").join(said, "path").withColumnRenamed("raw", "source").select(*[c.split(" ")[0] for c in DOCUMENT.split(", ")]))
    documents = reduce(DataFrame.unionByName, parts)
    return documents, spark.createDataFrame(notes, "source string, kind string, note string")
