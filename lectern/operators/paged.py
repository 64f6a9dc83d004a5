"""Text that came in pages: running headers, page numbers, broken words; and which pages need a second reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import dehyphenate, is_page_number, trim

PAGE = "\f"
#: Fewer pages than this have no running headers.
MIN_PAGES = 3


def page_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pages, page_no, line_no, line, bare, first, last): lines of texts of three pages or more; first and last mark a page's outermost lines that aren't blank."""
    pages = df.select(key, F.split(text, PAGE).alias("_pages")).where(F.size("_pages") >= MIN_PAGES)
    rows = pages.select(key, F.size("_pages").alias("pages"), F.posexplode("_pages").alias("page_no", "_page"))
    rows = rows.select(key, "pages", "page_no", F.posexplode(F.split("_page", "\n")).alias("line_no", "line")).withColumn("bare", trim(F.col("line")))
    page = W.partitionBy(key, "page_no")
    filled = F.when(F.col("bare") != "", F.col("line_no"))
    return rows.withColumn("first", F.col("line_no") == F.min(filled).over(page)).withColumn("last", F.col("line_no") == F.max(filled).over(page))


def running_headers(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bare, edges): lines that stand at the edge of more than half of a text's pages; a page counts a line once."""
    edges = page_lines(df, key, text).where("first or last").select(key, "pages", "page_no", "bare").distinct()
    return edges.groupBy(key, "bare", "pages").agg(F.count("*").alias("edges")).where(F.col("edges") > F.floor(F.col("pages") / 2)).drop("pages")


def clean_paged_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): running headers gone wherever they stand, page numbers gone from page edges, broken words joined.

    Texts of fewer than three pages only have their page breaks turned to line
    breaks.  Null text stays null.  Keys are taken to be distinct.
    """
    short = df.where(F.coalesce(F.size(F.split(text, PAGE)), F.lit(0)) < MIN_PAGES).select(key, dehyphenate(F.replace(text, F.lit(PAGE), F.lit("\n"))).alias(text))
    rows = page_lines(df, key, text)
    kept = rows.join(running_headers(df, key, text).select(key, "bare"), [key, "bare"], "left_anti")
    kept = kept.where(~(is_page_number(F.col("bare")) & (F.col("first") | F.col("last"))))
    # an array of one document's lines; a document that loses all of them is empty, not gone
    joined = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page_no", "line_no", "line"))).alias("_l"))
    long = df.where(F.size(F.split(text, PAGE)) >= MIN_PAGES).select(key).join(joined, key, "left")
    body = F.array_join(F.transform("_l", lambda x: x["line"]), "\n")
    return short.unionByName(long.select(key, dehyphenate(F.coalesce(body, F.lit(""))).alias(text)))


def pages_to_supplement(tables: Column, columns: Column, pages: Column) -> Column:
    """Pages to read again for their layout: those with tables, and those in columns unless most pages are."""
    tables, columns = (F.coalesce(c, F.array().cast("array<int>")) for c in (tables, columns))
    most = F.size(columns) * 2 > F.coalesce(pages, F.lit(0))
    return F.array_sort(F.array_union(tables, F.when((F.coalesce(pages, F.lit(0)) > 0) & most, F.array().cast("array<int>")).otherwise(columns)))


def append_layout(markdown: Column, page: Column, layout: Column) -> Column:
    """A page's text with its layout reading behind it, never in its place; without such a reading the text stays as it is."""
    headed = F.concat(F.coalesce(markdown, F.lit("")), F.lit("\n\n[page "), page.cast("string"), F.lit(", as laid out]\n\n"), layout)
    return F.when(layout.isNull() | (trim(layout) == ""), markdown).otherwise(headed)
