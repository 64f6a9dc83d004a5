"""URLs as Columns: parsing, resolving, comparing.  A URL that can't be read is null, as are all parts of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import let, trim

#: Extensions that are never a page to read.
NOT_A_PAGE = (
    "png jpg jpeg gif svg webp ico bmp avif mp4 webm mov mp3 wav ogg css js mjs map zip gz tgz bz2 xz tar 7z rar "
    "woff woff2 ttf otf eot exe dmg deb rpm msi iso wasm sig asc"
).split()
#: Extensions of pages whose query is decoration.
STATIC = ("html", "htm", "xhtml", "md", "txt", "pdf")


def normalize_path(path: Column) -> Column:
    """Without empty and dot segments; two dots take the segment before with them; a slash at the end stays."""
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "") | (s == "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s)),
    )
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(path.endswith("/") & (F.char_length(path) > 1) & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def _url(scheme: Column, host: Column, port: Column, path: Column, query: Column) -> Column:
    parts = {"scheme": scheme, "host": host, "port": port, "path": path, "query": F.when(query != "", query)}
    return F.named_struct(*[x for name, c in parts.items() for x in (F.lit(name), c)])


def parse(raw: Column) -> Column:
    """struct(scheme, host, port, path, query) of an absolute http(s) URL; the fragment is dropped, an IPv6 host keeps its brackets."""
    return let(trim(raw), lambda r: let(F.regexp_replace(F.regexp_extract(r, r"^(?s).*?://([^/?#]*)", 1), "^.*@", ""), lambda a: _parsed(r, a)))


def _parsed(raw: Column, authority: Column) -> Column:
    scheme = F.lower(F.regexp_extract(raw, r"^(?s)(.*?)://", 1))
    path = F.regexp_extract(raw, r"^(?s).*?://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(raw, r"^(?s).*?://[^?#]*\?([^#]+)", 1)
    bracketed = authority.startswith("[")
    port = F.when(bracketed, F.regexp_extract(authority, r"\]:(.*)$", 1)).otherwise(F.regexp_extract(authority, r":([^:]*)$", 1))
    has_port = F.when(bracketed, authority.rlike(r"\]:")).otherwise(F.contains(authority, F.lit(":")))
    host = F.when(bracketed, F.regexp_extract(authority, r"^(\[[^\]]*\])", 1)).otherwise(F.regexp_replace(authority, r":[^:]*$", ""))
    number = port.try_cast("int")
    good = scheme.isin("http", "https") & (authority != "") & (~bracketed | F.contains(authority, F.lit("]"))) & (~has_port | (port.rlike(r"^\d{1,5}$") & (number <= 65535)))
    return F.when(good, _url(scheme, F.lower(host), F.when(has_port, number), let(F.when(path == "", "/").otherwise(path), normalize_path), query))


def origin(u: Column) -> Column:
    return F.concat(u["scheme"], F.lit("://"), u["host"], F.coalesce(F.concat(F.lit(":"), u["port"].cast("string")), F.lit("")))


def render(u: Column) -> Column:
    return let(u, lambda u: F.concat(origin(u), u["path"], F.coalesce(F.concat(F.lit("?"), u["query"]), F.lit(""))))


def same_origin(a: Column, b: Column) -> Column:
    return (a["scheme"] == b["scheme"]) & (a["host"] == b["host"]) & a["port"].eqNullSafe(b["port"])


def directory(u: Column) -> Column:
    return F.regexp_extract(u["path"], r"^(?s)(.*/)", 1)


def last_segment(u: Column) -> Column:
    return F.regexp_extract(u["path"], r"(?s)([^/]*)/*$", 1)


def extension(u: Column) -> Column:
    """Lower case, without the dot; null where there is none."""
    ext = F.regexp_extract(last_segment(u), r"\.([A-Za-z0-9]+)$", 1)
    return F.when(ext != "", F.lower(ext))


def join(base: Column, href: Column) -> Column:
    """Where a link on a page leads; null for fragments and schemes that aren't fetched."""
    return let(base, lambda b: let(trim(F.regexp_extract(trim(href), r"^(?s)([^#]*)", 1)), lambda h: _joined(b, h)))


def _joined(base: Column, h: Column) -> Column:
    path, query = F.regexp_extract(h, r"^(?s)([^?]*)", 1), F.regexp_extract(h, r"^(?s)[^?]*\?(.+)$", 1)
    target = F.when(path == "", base["path"]).when(path.startswith("/"), path).otherwise(F.concat(directory(base), path))
    relative = _url(base["scheme"], base["host"], base["port"], let(target, normalize_path), query)
    scheme = F.regexp_extract(h, r"^(?s)(.*?)://", 1)
    absolute = F.when(h.startswith("//"), F.concat(base["scheme"], F.lit(":"), h)).when(F.contains(h, F.lit("://")) & scheme.rlike(r"^[A-Za-z0-9+.-]*$"), h)
    return (
        F.when((h == "") | base.isNull(), None)
        .when(h.startswith("//") | F.contains(h, F.lit("://")), parse(absolute))
        .when(h.rlike(r"^[A-Za-z]+:"), None)
        .otherwise(relative)
    )


def without_decoration(u: Column) -> Column:
    """The query goes where the page can't depend on it."""
    def bare(u: Column) -> Column:
        static = u["path"].endswith("/") | F.coalesce(extension(u).isin(*STATIC), F.lit(False))
        return F.when(u.isNotNull(), _url(u["scheme"], u["host"], u["port"], u["path"], F.when(~static, u["query"])))

    return let(u, bare)


def looks_like_a_page(u: Column) -> Column:
    return ~F.coalesce(extension(u).isin(*NOT_A_PAGE), F.lit(False))


def parent(path: Column) -> Column:
    """One directory up; null above the root."""
    cut = F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"^(?s)(.*/)", 1)
    return F.when(cut != "", cut)


def worth_following(u: Column, start: Column) -> Column:
    return let(u, lambda u: let(start, lambda s: same_origin(u, s) & F.startswith(u["path"], directory(s)) & looks_like_a_page(u)))


def beside(u: Column, start: Column) -> Column:
    """A page of the start's origin that isn't under its folder."""
    return let(u, lambda u: let(start, lambda s: same_origin(u, s) & ~F.startswith(u["path"], directory(s)) & looks_like_a_page(u)))
