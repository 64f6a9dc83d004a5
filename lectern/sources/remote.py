"""Answers from the web and checkouts of repositories.

The web is a Python data source: one partition per share of the addresses, one
connection at a time per host there, answers as rows, failures as rows too.
Registered as `lectern_http`; option `urls` is a list with line ends between.
"""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import subprocess
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Limits of one answer.
MOST_BYTES, SECONDS, PROBE_SECONDS, REDIRECTS = 64 * 1024 * 1024, 45, 10, 10
AGENT = "lectern/1 (documents reader)"


class _Redirects(urllib.request.HTTPRedirectHandler):
    max_redirections = REDIRECTS


def fetch(url: str, seconds: float = SECONDS, most: int = MOST_BYTES) -> tuple[str, bytes | None, str | None, str | None]:
    """(final url, bytes, content type in lower case, error); an empty answer, one too long and any status but success are errors."""
    if not re.match(r"(?i)https?://", url):
        return url, None, None, "only http and https are fetched"
    request = urllib.request.Request(url, headers={"User-Agent": AGENT})
    try:
        with urllib.request.build_opener(_Redirects).open(request, timeout=seconds) as answer:
            data = answer.read(most + 1)
            kind = answer.headers.get("Content-Type")
            if not data:
                return answer.url, None, None, "empty body"
            if len(data) > most:
                return answer.url, None, None, "body exceeds the limit"
            return answer.url, data, kind.lower() if kind else None, None
    except urllib.error.HTTPError as e:
        return url, None, None, f"http status: {e.code}"
    except (OSError, ValueError) as e:
        return url, None, None, str(e)[:300]


class HttpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lectern_http"

    def schema(self) -> str:
        return "asked string, url string, content_type string, bytes binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return HttpReader(self.options)


class HttpReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.urls = list(dict.fromkeys(u.strip() for u in options.get("urls", "").split("\n") if u.strip()))
        self.shares = max(1, int(options.get("partitions", "8")))
        self.delay = max(0, int(options.get("delay_ms", "0"))) / 1000

    def partitions(self) -> list[InputPartition]:
        # the addresses of one host stay together, so that no host is asked from two sides
        shares: dict[int, list[str]] = {}
        for u in self.urls:
            host = re.sub(r"^[a-z]+://([^/?#]*).*$", r"\1", u.lower())
            shares.setdefault(int(hashlib.md5(host.encode()).hexdigest(), 16) % self.shares, []).append(u)
        return [InputPartition(s) for s in shares.values()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for n, asked in enumerate(partition.value):
            if n and self.delay:
                time.sleep(self.delay)
            url, data, kind, error = fetch(asked)
            yield asked, url, kind, data, error


def read_urls(spark: SparkSession, urls: list[str], partitions: int = 8, delay_ms: int = 0) -> DataFrame:
    """(asked, url, content_type, bytes, error) of addresses; repeated ones are asked once, those of one host with a delay between them."""
    from lectern.sources.tables import ship

    ship(spark)
    spark.dataSource.register(HttpSource)
    return spark.read.format("lectern_http").option("urls", "\n".join(urls)).option("partitions", partitions).option("delay_ms", delay_ms).load()


# repositories


def checkout_name(label: str) -> str:
    return re.sub(r"[^A-Za-z0-9_-]", "-", label) + f"-{os.getpid()}"


def checkout(url: str, folder: str, label: str, branch: str | None = None, subdir: str | None = None) -> str:
    """A shallow checkout of one branch below a folder that all executors see; the path of it, or of its subfolder."""
    base = os.path.join(folder, checkout_name(label))
    target = next(p for n in range(100) if not os.path.exists(p := base if n == 0 else f"{base}-{n}"))
    command = ["git", "clone", "--quiet", "--depth", "1", "--single-branch", *(["--branch", branch] if branch else []), "--", url, target]
    done = subprocess.run(command, capture_output=True, text=True, timeout=600, env=os.environ | {"GIT_TERMINAL_PROMPT": "0"}, check=False)
    if done.returncode:
        shutil.rmtree(target, ignore_errors=True)
        raise RuntimeError(f"cloning {url}: {done.stderr.strip()[:300]}")
    inner = os.path.normpath(os.path.join(target, subdir)) if subdir else target
    if not os.path.isdir(inner) or not (inner + os.sep).startswith(target + os.sep):
        shutil.rmtree(target, ignore_errors=True)
        raise RuntimeError(f"{label} has no folder {subdir}")
    return inner


def read_checkout(spark: SparkSession, path: str, label: str, origin: str, include: list[str] | None = None, exclude: list[str] | None = None, most: int = 200) -> DataFrame:
    """The documents of a checkout in reading order: path as label:file, origin, local_path, method, text, error, place, dropped (how many were cut off)."""
    from pyspark.sql import functions as F

    from lectern.operators.sources import repo_select
    from lectern.sources.readers import read_files

    root = os.path.realpath(path)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    relative = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + re.escape(root) + "/", "")
    files = listed.select(F.lit(label).alias("repo"), relative.alias("file"), "length")
    chosen = repo_select(files, "repo", "file", F.col("length"), include, exclude, max(1, most))
    read = read_files(spark, root).withColumn("file", F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + re.escape(root) + "/", ""))
    return read.drop("path").join(chosen, "file").select(F.concat(F.lit(f"{label}:"), "file").alias("path"), F.lit(origin).alias("origin"), F.concat(F.lit(root + "/"), "file").alias("local_path"), "method", "text", "pages_needing_ocr", "error", "place", "dropped")


def tools() -> list[tuple[str, str | None]]:
    """(tool, path or nothing) of programs that add to what can be read."""
    return [(t, shutil.which(t)) for t in ("git", "pdftotext", "pdftoppm", "ebook-convert", "docling")]
