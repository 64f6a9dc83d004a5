"""Crawling as set algebra: robots rules, seeds, and a breadth-first walk level by level."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import urls as U
from lectern.sources.tables import checkpoint, in_batches

AGENT = "lectern"
#: How far a crawl goes by default.
MOST_PAGES, DEPTH, MOST_SITEMAPS = 50, 3, 5


def _records(body: str) -> list[tuple[str, str]]:
    """(field, value) of the lines that have both, without remarks."""
    parts = (line.partition("#")[0].partition(":") for line in body.split("\n"))
    return [(field.strip().lower(), value.strip()) for field, colon, value in parts if colon]


def robots_rules(body: str, agent: str = AGENT) -> list[tuple[str, bool]]:
    """(pattern, allow) of the groups that name us, else of those for everyone.

    A group is a run of agents and what follows up to the next run; rules before the first belong to nobody.
    """
    records = _records(body)
    names = [field == "user-agent" for field, _ in records]
    # a group begins at an agent that comes after something else
    group = [*accumulate(int(name and not before) for name, before in zip(names, [False, *names], strict=False))]
    agents, rules = defaultdict(set), []
    for g, (field, value) in zip(group, records, strict=True):
        if field == "user-agent":
            agents[g].add(value.lower())
        elif field == "allow" or (field == "disallow" and value):
            rules.append((g, value, field == "allow"))
    own = {g for g, of in agents.items() if any(agent.startswith(a) for a in of if a != "*")}
    own = own if any(g in own for g, *_ in rules) else {g for g, of in agents.items() if "*" in of}
    return [(pattern, allow) for g, pattern, allow in rules if g in own]


@lru_cache(10_000)
def compiled(pattern: str) -> tuple[re.Pattern[str], int]:
    """A rule as an expression, and how specific it is: the bytes it spells out.

    A star takes the first place where the next part stands, for good; a sign at the end asks for the path's end, unless a star stands before it.
    """
    spelled = pattern.removesuffix("$")
    head, *parts = map(re.escape, spelled.split("*"))
    closed = pattern.endswith("$") and not spelled.endswith("*")
    return re.compile(head + "".join(f"(?>.*?{p})" for p in parts if p) + r"\Z" * closed, re.S), len(spelled.replace("*", "").encode())


def allowed(rules: list[tuple[str, bool]], path: str) -> bool:
    """The most specific rule that matches decides, allowing on a tie; no rule allows."""
    matching = [(size, allow) for pattern, allow in rules for rule, size in [compiled(pattern)] if rule.match(path)]
    return max(matching)[1] if matching else True


def robots_allow(urls: DataFrame, robots: DataFrame, key: str, origin: str = "origin", path: str = "path", body: str = "body") -> DataFrame:
    """(key, allowed) of urls (key, origin, path) under robots (origin, body); a site without rules allows everything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple[str, bool]]] = {}
        for batch in batches:
            out = []
            for p, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if b is not None and b not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[b] = robots_rules(b)
                out.append(b is None or allowed(known[b], p or "/"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=[key, "allowed"])

    joined = urls.join(robots.select(origin, body), origin, "left").select(key, path, body)
    return in_batches(joined, run, f"`{key}` {urls.schema[key].dataType.simpleString()}, allowed boolean")


def seeds_of_index(text: Column) -> Column:
    """Link targets of a Markdown index."""
    return F.regexp_extract_all(text, F.lit(r"\]\(([^)\s]+)"), F.lit(1))


def seeds_of_sitemap(xml: Column) -> Column:
    """Locations of a sitemap, in order."""
    return F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))


def is_plain_text(content_type: Column, text: Column) -> Column:
    """Declared as text (or nothing), not empty, and not a page in disguise."""
    declared = content_type.isNull() | F.contains(content_type, F.lit("text/plain")) | F.contains(content_type, F.lit("markdown"))
    head = F.lower(F.left(text, F.lit(200)))
    page = head.rlike(r"^\s*(?:<!doctype|<html)") | F.contains(head, F.lit("<head>"))
    return declared & ~page & (text != "")


def outside_prefix(links: DataFrame, group: str) -> DataFrame:
    """(group, outside): distinct pages of the start's origin that lie beside its folder; links are (group, start, target), parsed."""
    rows = links.select(group, U.beside(F.col("target"), F.col("start")).alias("_beside"), U.render(F.col("target")).alias("_page"))
    return rows.groupBy(group).agg(F.count_distinct(F.when(F.col("_beside"), F.col("_page"))).alias("outside"))


def breadth_first(starts: DataFrame, links: DataFrame, depth: int = DEPTH, most: int = MOST_PAGES) -> DataFrame:
    """(crawl, page, depth, place): pages in the order a queue would visit them, at most ``most`` of each crawl.

    starts is (crawl, page), links (crawl, source, ordinal, target).  One step per
    level, cut from its lineage in the shared checkpoint folder; a page counts at its
    first link from the earliest page of the level above.
    """
    one = W.partitionBy("crawl").orderBy("page")
    level = checkpoint(starts.select("crawl", "page").distinct().withColumn("place", F.row_number().over(one)).where(F.col("place") <= most).withColumn("depth", F.lit(0)))
    seen = level
    for k in range(1, depth + 1):
        found = level.join(links.withColumnRenamed("source", "page"), ["crawl", "page"]).select("crawl", F.col("target").alias("page"), F.struct("place", "ordinal").alias("_o"))
        new = found.groupBy("crawl", "page").agg(F.min("_o").alias("_o")).join(seen.select("crawl", "page"), ["crawl", "page"], "left_anti")
        before = seen.groupBy("crawl").agg(F.max("place").alias("_b"))
        # the cut is on the row number itself, so each task passes on no more than ``most`` rows of a crawl
        new = new.withColumn("_n", F.row_number().over(W.partitionBy("crawl").orderBy("_o", "page"))).where(F.col("_n") <= most)
        level = checkpoint(new.join(before, "crawl").select("crawl", "page", (F.col("_n") + F.col("_b")).alias("place"), F.lit(k).alias("depth")).where(F.col("place") <= most))
        seen = seen.unionByName(level)
    return seen.where(F.col("place") <= most).select("crawl", "page", "depth", F.col("place").cast("bigint").alias("place"))
