"""Reading files as documents: text, HTML, office archives, spreadsheets; what can't be read becomes a row that says why.

Files come from Spark's binary source, so listing and reading are distributed;
each row is read where it is.  Formats that need a library that isn't there (PDF, legacy
office files, Kindle books) give a failure row, never an exception; a reader for
them can be passed in.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from typing import NamedTuple
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import html as H
from lectern.functions import text as T
from lectern.operators.paged import clean_paged_text
from lectern.operators.sources import path_extension, route
from lectern.sources.tables import in_batches, ship, stored

#: A reader turns the bytes of a file into text, or text and pages to look at (``Paged``); any exception is a failure of that file.
Reader = Callable[[bytes], "str | Paged"]
#: The most an archive may unpack to, against bombs.
MOST_UNPACKED = 256 * 1024 * 1024

_SHAPES = {
    "docx": r"word/document\.xml$", "docm": r"word/document\.xml$", "pptx": r"ppt/slides/slide\d+\.xml$", "pptm": r"ppt/slides/slide\d+\.xml$",
    "ppsx": r"ppt/slides/slide\d+\.xml$", "ppsm": r"ppt/slides/slide\d+\.xml$", "odt": r"content\.xml$", "odp": r"content\.xml$", "ods": r"content\.xml$",
}


def _members(data: bytes, pattern: str) -> Iterator[bytes]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if sum(i.file_size for i in z.infolist()) > MOST_UNPACKED:
            raise ValueError("the archive unpacks to too much")
        names = [n for n in z.namelist() if re.search(pattern, n)]
        for n in sorted(names, key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]):
            yield z.read(n)


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _paragraphs(xml: bytes) -> str:
    """Paragraphs and headings of an office document as Markdown lines, table cells side by side."""
    out: list[str] = []

    def walk(node: ElementTree.Element, parts: list[str]) -> None:
        kind = _name(node.tag)
        if kind in {"p", "h"}:
            own: list[str] = []
            style = next((v for e in node.iter() if _name(e.tag) == "pStyle" for k, v in e.attrib.items() if _name(k) == "val"), "")
            level = next((int(v) for k, v in node.attrib.items() if _name(k) == "outline-level" and v.isdigit()), 0) if kind == "h" else 0
            if m := re.match(r"(?i)heading ?(\d)", style):
                level = int(m.group(1))
            for e in node.iter():
                if _name(e.tag) in {"t", "p", "h", "span", "a"} and e.text:
                    own.append(e.text)
                if _name(e.tag) in {"tab"}:
                    own.append("\t")
                if _name(e.tag) in {"br", "line-break"}:
                    own.append("\n")
                if e is not node and e.tail and _name(e.tag) in {"span", "a", "s", "tab", "line-break"}:
                    own.append(e.tail)
            text = "".join(own).strip()
            if text:
                out.append("#" * min(level, 6) + " " * bool(level) + text)
            return
        for child in node:
            walk(child, parts)

    walk(ElementTree.fromstring(xml), [])
    return "\n\n".join(out)


def read_office(data: bytes, extension: str) -> str:
    if extension in _SHAPES:
        return "\n\n".join(filter(None, map(_paragraphs, _members(data, _SHAPES[extension]))))
    if extension == "epub":
        return "\n\n".join(filter(None, (H.strip_text(x.decode("utf-8", "replace")) for x in _members(data, r"\.x?html?$"))))
    if extension in {"xlsx", "xlsm"}:
        shared = [re.sub(r"\s+", " ", "".join(t.text or "" for t in s.iter() if _name(t.tag) == "t")) for x in _members(data, r"xl/sharedStrings\.xml$") for s in ElementTree.fromstring(x)]
        sheets = []
        for x in _members(data, r"xl/worksheets/sheet\d+\.xml$"):
            rows = []
            for row in (e for e in ElementTree.fromstring(x).iter() if _name(e.tag) == "row"):
                cells = []
                for c in (e for e in row if _name(e.tag) == "c"):
                    v = next((e.text or "" for e in c.iter() if _name(e.tag) in {"v", "t"}), "")
                    cells.append(shared[int(v)] if c.get("t") == "s" and v.isdigit() and int(v) < len(shared) else v)
                if any(cells):
                    rows.append("| " + " | ".join(cells) + " |")
            sheets.append("\n".join(rows))
        return "\n\n".join(filter(None, sheets))
    if extension == "csv":
        import csv

        rows = csv.reader(io.StringIO(data.decode("utf-8", "replace")))
        return "\n".join("| " + " | ".join(r) + " |" for r in rows if any(r))
    if extension == "rtf":
        plain = re.sub(r"\\par[d]?\b ?", "\n", data.decode("latin-1"))
        plain = re.sub(r"\{\\\*?\\?(?:fonttbl|colortbl|stylesheet|info)(?:[^{}]|\{[^{}]*\})*\}", "", plain)
        plain = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m.group(1)).decode("cp1252", "replace"), plain)
        return re.sub(r"\\[a-zA-Z]+-?\d* ?|[{}]", "", plain).strip()
    raise ValueError(f"no reader for .{extension}")


class Paged(NamedTuple):
    """What a reader of paged files may say beside the text."""

    text: str
    pages_needing_ocr: list[int] = []


_READ = "path string, extension string, method string, text string, pages_needing_ocr array<int>, error string"


def read_rows(rows: DataFrame, pdf: Reader | None = None) -> DataFrame:
    """(path, extension, method, text, pages_needing_ocr, error) of files (path, extension, content).

    Local HTML keeps its furniture (only fetched pages are cut to their content); bytes
    that aren't UTF-8 are replaced; text is null where error is set, or where all of its pages have to be looked at.
    """
    rows = rows.select("path", "extension", "content", route(F.col("extension")).alias("route"))
    none = (F.array().cast("array<int>").alias("pages_needing_ocr"), F.lit(None).cast("string").alias("error"))
    plain = rows.where("route = 'text'").select("path", "extension", F.lit("plain-text").alias("method"), T.lossy(F.col("content")).alias("text"), *none)
    pages = rows.where("route = 'html'").select("path", "extension", F.lit("html-strip").alias("method"), H.strip(T.lossy(F.col("content"))).alias("text"), *none)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors, methods, looked = [], [], [], []
            for data, extension, kind in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                text, error, look = None, None, []
                try:
                    if kind == "office":
                        text = read_office(data, extension)
                    elif kind == "pdf" and pdf is not None:
                        found = pdf(data)
                        text, look = found if isinstance(found, Paged) else (found, [])
                    else:
                        error = f"no reader for .{extension}" if kind else f"unsupported: .{extension}"
                except Exception as e:  # noqa: BLE001 - one bad file must not end the run
                    error = f"{type(e).__name__}: {e}"[:500]
                texts.append(text)
                errors.append(error)
                looked.append(look)
                methods.append("anydoc" if kind == "office" else "pdf-markdown" if kind == "pdf" else None)
            arrays = [batch.column(0), batch.column(1), pa.array(methods, pa.string()), pa.array(texts, pa.string()), pa.array(looked, pa.list_(pa.int32())), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["path", "extension", "method", "text", "pages_needing_ocr", "error"])

    other = rows.where("route IS NULL OR route IN ('office', 'kindle', 'pdf')").select("path", "extension", "content", "route")
    rest = in_batches(other, convert, _READ)
    if pdf is None:
        return plain.unionByName(pages).unionByName(rest)
    # each file is parsed once; what was read is cleaned of its pages' edges from a table
    rest = stored(rest)
    paged = rest.where("method = 'pdf-markdown' AND text IS NOT NULL")
    cleaned = paged.drop("text").join(clean_paged_text(paged, "path"), "path").select(*rest.columns)
    unpaged = rest.where("NOT (method <=> 'pdf-markdown' AND text IS NOT NULL)")
    return plain.unionByName(pages).unionByName(unpaged).unionByName(cleaned)


def read_files(spark: SparkSession, path: str, glob: str | None = None, pdf: Reader | None = None) -> DataFrame:
    """``read_rows`` of the files under a path."""
    ship(spark)
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (source.option("pathGlobFilter", glob) if glob else source).load(path)
    return read_rows(files.select("path", path_extension(F.col("path")).alias("extension"), "content"), pdf)


def read_skills(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(skills, refs) under a folder: each SKILL.md that lies in no other skill, and the files of its references folder."""
    from lectern.operators.skills import field, frontmatter

    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", T.lossy(F.col("content")).alias("raw"))
    files = files.where(~F.col("path").rlike(r"/(?:\.[^/]+|node_modules|target|venv)/"))
    own = files.where(F.col("path").endswith("/SKILL.md")).withColumn("dir", F.regexp_replace("path", r"/SKILL\.md$", ""))
    # a folder's ancestors, so that nested skills are found by equality
    steps = F.split("dir", "/")
    above = own.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))).alias("_above"))
    inner = above.join(own.select(F.col("dir").alias("_above")), "_above").select("dir").distinct()
    top = own.join(inner, "dir", "left_anti").withColumn("f", frontmatter(F.col("raw")))
    named = ("name", "description", "license")
    skills = top.select(
        F.xxhash64("dir").alias("skill_id"), F.regexp_extract("dir", r"([^/]+)$", 1).alias("dir_name"), "path", *[field(F.col("f.fields"), k).alias(k) for k in named],
        F.filter("f.fields", lambda x: ~x["key"].isin(*named)).alias("extra"), F.col("f.body").alias("body"), "dir",
    )
    refs = files.withColumn("dir", F.regexp_extract("path", r"^(.*)/references/.+$", 1)).join(skills.select("dir", "skill_id"), "dir")
    return skills.drop("dir"), refs.select("skill_id", F.regexp_extract("path", r"/(references/.+)$", 1).alias("path"), F.col("raw").alias("text"))
