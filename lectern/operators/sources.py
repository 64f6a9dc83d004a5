"""What a source string names, how a file is read, and which files of a checkout are worth reading."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import urls as U
from lectern.functions.text import trim
from lectern.sources.tables import numbered

#: Extensions by the way they are read.
ROUTES = {
    "text": "txt text md markdown rst adoc asciidoc".split(),
    "html": "html htm xhtml".split(),
    "office": "doc docx docm odt ppt pps pot pptx pptm ppsx ppsm rtf epub xls xlsx xlsm xlsb ods odp csv".split(),
    "kindle": "mobi azw azw3".split(),
    "pdf": ["pdf"],
}
#: Extensions by declared type.
MIME = {
    "application/pdf": "pdf", "application/epub+zip": "epub", "application/rtf": "rtf", "text/rtf": "rtf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.oasis.opendocument.text": "odt", "text/markdown": "md", "text/x-markdown": "md", "text/csv": "csv", "text/plain": "txt",
    "text/html": "html", "application/xhtml+xml": "html",
}
#: What is read of a checkout.
DOC_EXTENSIONS = "md mdx markdown rst txt text adoc asciidoc pdf".split()
SKIP_DIRS = "node_modules target vendor dist build out coverage __pycache__ site-packages third_party".split()
MOST_BYTES, MOST_FILES = 2 * 1024 * 1024, 200


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs.items() for x in p])


def route(extension: Column) -> Column:
    """text, html, office, kindle or pdf; null for what isn't supported."""
    return F.try_element_at(_map({e: r for r, es in ROUTES.items() for e in es}), F.lower(extension))


def formats() -> list[str]:
    return sorted(e for es in ROUTES.values() for e in es)


def path_extension(path: Column) -> Column:
    ext = F.regexp_extract(F.regexp_replace(path, r"[?#].*$", ""), r"[^/\\]\.([^./\\]+)$", 1)
    return F.when(ext != "", F.lower(ext))


def is_html(content_type: Column, url: Column) -> Column:
    """By the declared type; undeclared, by the url's extension."""
    kind = F.lower(content_type)
    ext = U.extension(U.parse(url))
    return F.when(content_type.isNotNull(), F.contains(kind, F.lit("html")) | F.contains(kind, F.lit("xml+xhtml"))).otherwise(ext.isNull() | ext.isin("html", "htm", "xhtml"))


def download_extension(content_type: Column, url: Column) -> Column:
    """What to save an answer as: by its type, else by its url, else html."""
    mime = trim(F.try_element_at(F.split(content_type, ";"), F.lit(1)))
    return F.coalesce(F.try_element_at(_map(MIME), mime), U.extension(U.parse(url)), F.lit("html"))


def download_names(df: DataFrame, key: str, url: str = "url", content_type: str = "content_type") -> DataFrame:
    """(key, name): the last part of the url made safe, numbered from the second of a name on in the order of the integer key."""
    u, ext = U.parse(F.col(url)), download_extension(F.col(content_type), F.col(url))
    safe = F.regexp_replace(F.regexp_replace(U.last_segment(u), "[^A-Za-z0-9._-]", "_"), "^_+|_+$", "")
    named = df.select(key, F.when(safe == "", "download").otherwise(safe).alias("_s"), ext.alias("_e"))
    dotted = F.concat(F.lit("."), F.col("_e"))
    stem = F.when(F.endswith(F.lower("_s"), dotted), F.left("_s", F.char_length("_s") - F.char_length(dotted))).otherwise(F.col("_s"))
    placed = numbered(named.withColumn("_stem", stem), ["_stem", "_e"], key, "_place")
    return placed.select(key, F.concat("_stem", F.when(F.col("_place") > 1, F.concat(F.lit("-"), F.col("_place").cast("string"))).otherwise(""), dotted).alias("name"))


def _strip_git(c: Column) -> Column:
    return F.regexp_replace(c, r"(?:\.git)+$", "")


def _spec(kind: str | Column, url: Column, branch: Column | None = None, subdir: Column | None = None, label: Column | None = None, error: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    fields = {"kind": F.lit(kind) if isinstance(kind, str) else kind, "url": url, "branch": branch, "subdir": subdir, "label": label, "error": error}
    return F.named_struct(*[x for name, c in fields.items() for x in (F.lit(name), null if c is None else c.cast("string"))])


def _hub(owner: Column, name: Column) -> Column:
    return F.concat(F.lit("https://github.com/"), owner, F.lit("/"), _strip_git(name), F.lit(".git"))


def shorthand(raw: Column) -> Column:
    """owner/repo[/sub][@branch] of the usual host."""
    cut = F.regexp_extract(raw, r"^([^@]*)@(?s)(.+)$", 1)
    has_branch = raw.rlike(r"(?s)^[^@]*@.+")
    parts = F.filter(F.split(F.when(has_branch, cut).otherwise(raw), "/"), lambda p: p != "")
    owner, name = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    subdir = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), "/"))
    good = _spec("repo", _hub(owner, name), F.when(has_branch, F.regexp_extract(raw, r"(?s)^[^@]*@(.+)$", 1)), subdir, F.concat(owner, F.lit("/"), _strip_git(name)))
    return F.when(F.size(parts) >= 2, good).otherwise(_spec("error", raw, error=F.lit("expected owner/repo")))


def looks_like_shorthand(raw: Column) -> Column:
    return raw.rlike(r"^[A-Za-z0-9_-]+/[A-Za-z0-9_-]+(?:@[^/]*)?$")


def _web(raw: Column) -> Column:
    def of_url(u: Column) -> Column:
        return U.let(F.filter(F.split(u["path"], "/"), lambda p: p != ""), lambda parts: of_parts(u, parts))

    def of_parts(u: Column, parts: Column) -> Column:
        def at(n: int) -> Column:
            return F.try_element_at(parts, F.lit(n))

        def rest(n: int) -> Column:
            return F.array_join(F.slice(parts, F.lit(n), F.greatest(F.size(parts) - (n - 1), F.lit(0))), "/")

        hub = u["host"].isin("github.com", "www.github.com")
        label = F.concat(at(1), F.lit("/"), _strip_git(at(2)))
        raw_file = F.concat(F.lit("https://raw.githubusercontent.com/"), label, F.lit("/"), rest(4))
        lab = F.concat(F.lit("https://gitlab.com/"), label, F.lit(".git"))
        return (
            F.when(u.isNull(), _spec("error", raw, error=F.lit("not a URL that can be fetched")))
            .when(hub & (F.size(parts) == 2), _spec("repo", _hub(at(1), at(2)), label=label))
            .when(hub & (at(3) == "tree") & (F.size(parts) >= 4), _spec("repo", _hub(at(1), at(2)), at(4), F.when(F.size(parts) > 4, rest(5)), label))
            .when(hub & (at(3) == "blob") & (F.size(parts) >= 5), _spec("web", raw_file))
            .when((u["host"] == "gitlab.com") & (F.size(parts) == 2), _spec("repo", lab, label=label))
            .otherwise(_spec("web", U.render(u)))
        )

    return U.let(U.parse(raw), of_url)


def classify(raw: Column, exists: Column | None = None) -> Column:
    """struct(kind, url, branch, subdir, label, error) of a source string; kind is file, web, repo or error.

    A path that exists is a file whatever it looks like; ``exists`` says so, false by default.
    """
    raw = trim(raw)
    exists = F.lit(False) if exists is None else F.coalesce(exists, F.lit(False))
    remote = raw.rlike("^git@") | raw.endswith(".git")
    return (
        F.when(raw.isNull() | (raw == ""), _spec("error", raw, error=F.lit("empty source")))
        .when(exists, _spec("file", raw))
        .when(raw.rlike("^https?://"), _web(raw))
        .when(raw.startswith("gh:"), shorthand(F.substr(raw, F.lit(4))))
        .when(remote, _spec("repo", raw, label=_strip_git(F.regexp_extract(raw, r"([^/:]*)$", 1))))
        .when(looks_like_shorthand(raw), shorthand(raw))
        .otherwise(_spec("file", raw))
    )


def glob_pattern(glob: str) -> str:
    """The regular expression of a glob: * within a segment, ** across, ? one sign; upper and lower case alike."""
    out = re.sub(r"\*\*/|\*\*|\*|\?|[^*?]+", lambda m: {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(m.group(), "".join("\\" + c if c in r"\.+()[]{}^$|-" else c for c in m.group())), glob)
    return f"(?is)^{out}$"


def glob_matches(path: Column, glob: str) -> Column:
    return path.rlike(glob_pattern(glob))


def reading_rank(path: Column) -> Column:
    """0 the readme at the root, 1 documentation folders, 2 other readmes, 3 the rest."""
    low = F.lower(path)
    file = F.regexp_extract(low, r"([^/]*)$", 1)
    return F.when(file.startswith("readme") & ~F.contains(low, F.lit("/")), 0).when(low.rlike("^(?:docs|doc|guide)/"), 1).when(file.startswith("readme"), 2).otherwise(3)


def repo_select(files: DataFrame, key: str, path: str, size: Column | None = None, include: list[str] | None = None, exclude: list[str] | None = None, most: int = MOST_FILES) -> DataFrame:
    """(key, path, rank, place, dropped): the files of each checkout (key) worth reading, in reading order, at most ``most``; dropped counts the rest."""
    p = F.col(path)
    keep = ~p.rlike(r"(?:^|/)\.") & ~p.rlike(r"(?:^|/)(?:" + "|".join(SKIP_DIRS) + ")/")
    if size is not None:
        keep = keep & (size <= MOST_BYTES)
    if exclude:
        keep = keep & ~reduce(Column.__or__, [glob_matches(p, g) for g in exclude])
    wanted = reduce(Column.__or__, [glob_matches(p, g) for g in include]) if include else path_extension(p).isin(*DOC_EXTENSIONS)
    ranked = files.where(keep & F.coalesce(wanted, F.lit(False))).select(key, path).distinct().withColumn("rank", reading_rank(p))
    # the cut is on the row number itself, so each task passes on no more than ``most`` rows of a checkout
    placed = ranked.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("rank", path))).where(F.col("place") <= most)
    counts = ranked.groupBy(key).agg(F.count("*").alias("_all"))
    return placed.join(counts, key).select(key, path, "rank", F.col("place").cast("bigint").alias("place"), F.greatest(F.col("_all") - most, F.lit(0)).alias("dropped"))


def read_outcome(text: Column, ocr_pages: Column) -> Column:
    """read; visual where there is no text but pages to look at; failed where there is neither."""
    blank = trim(F.coalesce(text, F.lit(""))) == ""
    return F.when(~blank, "read").when(F.coalesce(F.size(ocr_pages), F.lit(0)) > 0, "visual").otherwise("failed")


def combined_text(docs: DataFrame, group: str, key: str, label: Column, is_file: Column, text: str = "text") -> DataFrame:
    """(group, key, part): what each document adds to its group's combined text, files under a heading where a group has several.

    Parts in the order of the key, two line ends between them, are the combined
    text; it is written as such by sorting within the group's partitions, and never held whole.
    """
    kept = docs.where(trim(F.coalesce(text, F.lit(""))) != "").select(group, key, label.alias("_label"), is_file.alias("_file"), text)
    counts = kept.groupBy(group).agg(F.count("*").alias("_n"))
    headed = F.when((F.col("_n") > 1) & F.col("_file"), F.concat(F.lit("# "), "_label", F.lit("\n\n"), text)).otherwise(F.col(text))
    # eqNullSafe: documents without a group are a group
    rows = kept.join(counts.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")))
    return rows.select(group, key, headed.alias("part"))
