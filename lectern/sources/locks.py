"""The record of a build, from which it can be read again: what was read, with which options, and what it hashed to."""

from __future__ import annotations

import json
import os
import re
from dataclasses import asdict, dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lectern.operators.snapshots import changelog

VERSION = 1


@dataclass
class Options:
    """How sources are read; anything missing in a record has its default, limits are at least 1."""

    crawl: bool = False
    max_pages: int = 50
    depth: int = 3
    delay_ms: int = 250
    no_llms_txt: bool = False
    branch: str | None = None
    max_files: int = 200
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.max_pages, self.max_files = max(1, self.max_pages), max(1, self.max_files)


@dataclass
class Lock:
    name: str = ""
    built_with: str = ""
    model: str = ""
    purpose: str = "working-guide"
    built_at: str = ""
    content_hash: str = ""
    characters: int = 0
    estimated_tokens: int = 0
    source_inputs: list[str] = field(default_factory=list)
    source_options: Options = field(default_factory=Options)
    documents: list[dict[str, str]] = field(default_factory=list)
    version: int = VERSION

    @classmethod
    def load(cls, path: str) -> Lock:
        with open(path, encoding="utf-8") as f:
            data: dict[str, Any] = json.load(f)
        known = {x.name for x in fields(cls)}
        options = data.get("source_options") or {}
        own = {x.name for x in fields(Options)}
        lock = cls(**{k: v for k, v in data.items() if k in known and k != "source_options"}, source_options=Options(**{k: v for k, v in options.items() if k in own}))
        if not lock.source_inputs:
            raise ValueError("the record names no sources to read again")
        return lock

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(json.dumps(asdict(self), indent=2, ensure_ascii=False) + "\n")

    def snapshot(self, spark: SparkSession) -> DataFrame:
        """(key, content_hash) of the documents on record; of several with one path the last."""
        rows = {d["path"]: d["content_hash"] for d in self.documents}
        return spark.createDataFrame(sorted(rows.items()), "key string, content_hash string")


def write_files(folder: str, files: list[tuple[str, str]]) -> list[str]:
    """Files of a skill below its folder, later ones over earlier ones of the same path; the paths written."""
    root = os.path.realpath(folder)
    for path, body in files:
        full = os.path.realpath(os.path.join(root, path))
        if not full.startswith(root + os.sep):
            raise ValueError(f"outside the folder: {path}")
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w", encoding="utf-8") as f:
            f.write(body)
    return sorted({p for p, _ in files})


def write_changelog(folder: str, entry: str) -> None:
    path = os.path.join(folder, "CHANGELOG.md")
    existing = ""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            existing = f.read()
    with open(path, "w", encoding="utf-8") as f:
        f.write(changelog(entry, existing))


def skill_roots(home: str, here: str) -> list[str]:
    """Folders where skills usually are, those that exist, each once however it is linked."""
    likely = [os.path.join(b, s) for b in (here, home) for s in (".agents/skills", "skills")]
    return list(dict.fromkeys(os.path.realpath(p) for p in likely if os.path.isdir(p)))


def newest(files: list[tuple[str, float]]) -> str | None:
    """The path changed last, the later one of equals; what a converter leaves in its folder is found by it."""
    found = None
    for path, at in files:
        if re.search(r"(?i)\.md$", path) and (found is None or at >= found[1]):
            found = (path, at)
    return found[0] if found else None
