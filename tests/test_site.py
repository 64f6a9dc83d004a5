import http.server
import os
import subprocess
import threading

import pytest

from lectern.operators import site
from lectern.sources import locks, remote

TEXT = "word " * 60


def _page(title, *links):
    body = "".join(f"<a href='{x}'>x</a>" for x in links)
    return f"<html><title>{title}</title><body><nav>menu</nav><article><p>{TEXT}</p>{body}</article></body></html>".encode()


def test_crawl_site(spark):
    pages = {
        "https://s.example/docs/": _page("Start", "a.html?x=1", "b.html", "/other/", "pic.png", "mailto:x@y.example", "missing.html", "file.pdf"), "https://s.example/docs/a.html": _page("A", "c.html", "./"),
        "https://s.example/docs/b.html": _page("B", "secret/x.html"), "https://s.example/docs/c.html": _page("C"), "https://s.example/docs/secret/x.html": _page("X"), "https://s.example/other/": _page("O"),
    }
    rows = [(1, u, "text/html", b) for u, b in pages.items()] + [(1, "https://s.example/docs/file.pdf", "application/pdf", b"%PDF"), (1, "https://s.example/docs/a.html?utm=2", None, pages["https://s.example/docs/a.html"])]
    answers = spark.createDataFrame(rows, "crawl int, url string, content_type string, bytes binary")
    starts = spark.createDataFrame([(1, "https://s.example/docs/"), (2, "https://t.example/")], "crawl int, start string")
    robots = spark.createDataFrame([("https://s.example", "User-agent: *\nDisallow: /docs/secret/")], "origin string, body string")
    documents, statistics = site.crawl_site(answers, starts, robots)
    got = {r["url"].rsplit("/", 1)[1]: r for r in documents.collect() if r["crawl"] == 1}
    assert set(got) == {"", "a.html", "b.html", "c.html", "file.pdf"} and got["file.pdf"]["text"] is None
    assert got["a.html"]["text"].startswith("# A\n\nsource: https://s.example/docs/a.html\n\nword") and "menu" not in got["a.html"]["text"]
    assert [got[k]["depth"] for k in ("", "a.html", "c.html")] == [0, 1, 2]
    stats = {r["crawl"]: r.asDict() for r in statistics.collect()}
    assert stats[1] == {"crawl": 1, "pages_fetched": 5, "skipped_by_robots": 1, "outside_prefix": 1, "hit_page_limit": False}
    limited = site.crawl_site(answers, starts, None, most=2)[1]
    assert {r["crawl"]: (r["pages_fetched"], r["hit_page_limit"]) for r in limited.collect()}[1] == (2, True)
    said = {(r["crawl"], r["note"]) for r in site.notes(limited).collect()}
    assert (1, "stopped at the limit of pages: 2") in said and (1, "1 pages lie outside the folder of the start") in said


class _Handler(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path == "/gone":
            self.send_error(410)
        elif self.path == "/move":
            self.send_response(302)
            self.send_header("Location", "/ok")
            self.end_headers()
        else:
            self.send_response(200)
            self.send_header("Content-Type", "Text/HTML")
            self.end_headers()
            self.wfile.write(b"" if self.path == "/empty" else b"<p>hi</p>")

    def log_message(self, *a):
        pass


def test_read_urls(spark):
    server = http.server.HTTPServer(("127.0.0.1", 0), _Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        rows = remote.read_urls(spark, [f"{base}/ok", f"{base}/ok", f"{base}/move", f"{base}/gone", f"{base}/empty", "ftp://x/", "http://127.0.0.1:1/"], 2).collect()
    finally:
        server.shutdown()
    got = {r["asked"].removeprefix(base): r for r in rows}
    assert len(rows) == 6 and got["/ok"]["content_type"] == "text/html" and bytes(got["/ok"]["bytes"]) == b"<p>hi</p>"
    assert got["/move"]["url"] == f"{base}/ok" and got["/gone"]["error"] == "http status: 410" and got["/empty"]["error"] == "empty body"
    assert got["ftp://x/"]["error"] and got["http://127.0.0.1:1/"]["error"]


def test_checkout(spark, tmp_path):
    repo = tmp_path / "repo"
    (repo / "docs").mkdir(parents=True)
    for name, text in {"README.md": "read", "docs/a.md": "a", "b.md": "b", "c.rs": "c"}.items():
        (repo / name).write_text(text)
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t.example", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    run("add", "-A")
    run("commit", "-q", "-m", "x")
    path = remote.checkout(str(repo), str(tmp_path), "own/repo", "main")
    rows = remote.read_checkout(spark, path, "own/repo", "https://h.example/own/repo.git", most=2).collect()
    assert sorted((r["place"], r["path"], r["text"], r["dropped"]) for r in rows) == [(1, "own/repo:README.md", "read", 1), (2, "own/repo:docs/a.md", "a", 1)]
    assert remote.checkout(str(repo), str(tmp_path), "own/repo", subdir="docs").endswith("/docs")
    for bad in ({"subdir": "../.."}, {"branch": "none"}):
        with pytest.raises(RuntimeError):
            remote.checkout(str(repo), str(tmp_path), "x", **bad)
    assert dict(remote.tools())["git"]


def test_locks(spark, tmp_path):
    path = str(tmp_path / "lock.json")
    lock = locks.Lock(name="n", source_inputs=["a"], source_options=locks.Options(max_pages=0), documents=[{"path": "p", "content_hash": "1"}, {"path": "p", "content_hash": "2"}])
    lock.save(path)
    again = locks.Lock.load(path)
    assert again == lock and again.source_options.max_pages == 1 and [tuple(r) for r in again.snapshot(spark).collect()] == [("p", "2")]
    (tmp_path / "old.json").write_text('{"name": "x", "source_inputs": ["a"], "unknown": 1, "source_options": {"depth": 5, "odd": 2}}')
    assert locks.Lock.load(str(tmp_path / "old.json")).source_options.depth == 5
    (tmp_path / "none.json").write_text("{}")
    with pytest.raises(ValueError):
        locks.Lock.load(str(tmp_path / "none.json"))
    assert locks.write_files(str(tmp_path / "s"), [("SKILL.md", "a"), ("references/b.md", "b"), ("SKILL.md", "c")]) == ["SKILL.md", "references/b.md"]
    assert (tmp_path / "s/SKILL.md").read_text() == "c"
    with pytest.raises(ValueError):
        locks.write_files(str(tmp_path / "s"), [("../x", "a")])
    locks.write_changelog(str(tmp_path / "s"), "one")
    locks.write_changelog(str(tmp_path / "s"), "two")
    log = (tmp_path / "s/CHANGELOG.md").read_text()
    assert log.count("# Changelog") == 1 and log.index("two") < log.index("one")
    assert locks.newest([("a.md", 1.0), ("b.md", 2.0), ("c.md", 2.0), ("d.txt", 9.0)]) == "c.md" and locks.newest([]) is None
    (tmp_path / "h/skills").mkdir(parents=True)
    os.symlink(tmp_path / "h/skills", tmp_path / "skills")
    assert locks.skill_roots(str(tmp_path / "h"), str(tmp_path)) == [str(tmp_path / "h/skills")]
