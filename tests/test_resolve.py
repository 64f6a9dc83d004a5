"""Sources of all kinds as one table: a local server, a local repository, files."""

import http.server
import subprocess
import threading

import pytest

from lectern import api
from lectern.sources.locks import Lock, Options
from lectern.sources.readers import Paged

TEXT = "word " * 60


def _page(title, *links):
    body = "".join(f"<a href='{x}'>x</a>" for x in links)
    return f"<html><title>{title}</title><body><nav>menu</nav><article><p>{TEXT}</p>{body}</article></body></html>"


SITE = {
    "/docs/": _page("Start", "a.html", "closed/x.html", "/other/", "data.csv", "gone.html"), "/docs/a.html": _page("A", "c.html"), "/docs/c.html": _page("C"), "/docs/closed/x.html": _page("X"),
    "/docs/mapped.html": _page("Mapped"), "/docs/listed.html": _page("Listed"), "/other/": _page("Other"), "/docs/data.csv": "a,b\n1,2\n", "/robots.txt": "User-agent: *\nDisallow: /docs/closed/",
    "/sitemap.xml": "<sitemapindex><loc>{base}/map2.xml</loc></sitemapindex>", "/map2.xml": "<urlset><url><loc>{base}/docs/mapped.html</loc></url><url><loc>{base}/other/</loc></url></urlset>",
    "/llms.txt": "# Site\n- [one](/docs/listed.html)\n- [two](https://elsewhere.example/docs/)",
}
KINDS = {"csv": "text/csv", "xml": "text/xml", "txt": "text/plain"}


class _Handler(http.server.BaseHTTPRequestHandler):
    site: dict = {}

    def do_GET(self):
        body = self.site.get(self.path)
        if body is None:
            self.send_error(404)
            return
        self.send_response(200)
        self.send_header("Content-Type", KINDS.get(self.path.rsplit(".", 1)[-1], "text/html"))
        self.end_headers()
        self.wfile.write(body.replace("{base}", f"http://127.0.0.1:{self.server.server_port}").encode())

    def log_message(self, *a):
        pass


@pytest.fixture
def server():
    handler = type("Handler", (_Handler,), {"site": dict(SITE)})
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", handler.site
    s.shutdown()


def _repository(folder):
    (folder / "docs").mkdir(parents=True)
    for name, text in {"README.md": "read", "docs/a.md": "a", "b.md": "b"}.items():
        (folder / name).write_text(text)
    for command in (["init", "-q", "-b", "main"], ["add", "-A"], ["commit", "-q", "-m", "x"]):
        subprocess.run(["git", "-C", str(folder), "-c", "user.name=t", "-c", "user.email=t@t.example", *command], check=True, capture_output=True)


def test_sources_of_all_kinds(spark, server, tmp_path):
    base, _ = server
    _repository(tmp_path / "own.git")
    (tmp_path / "a.txt").write_text("plain")
    sources = [str(tmp_path / "a.txt"), f"{base}/docs/a.html", f"{base}/docs/data.csv", f"{base}/none", f"file://{tmp_path}/own.git", str(tmp_path / "missing"), " "]
    docs, notes = api.resolve(spark, sources, Options(max_files=2))
    rows = docs.collect()
    got = {(r["source"], r["path"].rsplit("/", 1)[-1]): r for r in rows}
    assert got[sources[0], "a.txt"]["text"] == "plain" and got[sources[0], "a.txt"]["local_path"] == sources[0] and got[sources[0], "a.txt"]["content_hash"]
    page = got[sources[1], "a.html"]
    assert (page["kind"], page["method"], page["origin"]) == ("page", "web-page", sources[1]) and page["text"].startswith("# A\n\nsource: ") and "menu" not in page["text"]
    assert got[sources[2], "data.csv"]["method"] and "1" in got[sources[2], "data.csv"]["text"]
    assert "404" in got[sources[3], "none"]["error"]
    repo = [r for r in rows if r["kind"] == "repo"]
    assert {r["path"] for r in repo} == {"own:README.md", "own:docs/a.md"} and all(r["origin"] == sources[4] and r["local_path"].endswith(".md") for r in repo)
    assert [r["error"] is not None for r in rows if r["source"] in sources[5:]] == [True, True]
    said = [r["note"] for r in notes.collect()]
    assert "1 more files matched than the limit of 2" in said and any("checkout" in n for n in said)


def test_a_living_site(spark, server):
    base, site = server
    options = Options(crawl=True, delay_ms=0)
    docs, notes = api.resolve(spark, [f"{base}/docs/"], options)
    got = {r["path"].removeprefix(base): r for r in docs.collect()}
    # linked, mapped and listed pages of the folder, by the site's rules; a table behind a link by its format
    assert set(got) == {"/docs/", "/docs/a.html", "/docs/c.html", "/docs/mapped.html", "/docs/listed.html", "/docs/data.csv"}
    assert got["/docs/data.csv"]["method"] != "web-page" and got["/docs/c.html"]["kind"] == "site" and all(r["error"] is None for r in got.values())
    said = [r["note"] for r in notes.collect()]
    assert any("outside the folder" in n for n in said) and any("gone.html" in n and "404" in n for n in said)
    few = api.resolve(spark, [f"{base}/docs/"], Options(crawl=True, delay_ms=0, max_pages=2))
    assert few[0].count() == 2 and any("limit of pages" in r["note"] for r in few[1].collect())
    site["/robots.txt"] = "User-agent: *\nDisallow: /"
    closed = api.extract(spark, [f"{base}/docs/"], options=options).collect()
    assert len(closed) == 1 and "closed to crawlers" in closed[0]["error"]
    # all of the text in one file goes before a walk from the root, unless it is a page in disguise or isn't wanted
    site["/robots.txt"] = ""
    site["/llms-full.txt"] = "All of it."
    site["/"] = _page("Root")
    whole = api.resolve(spark, [f"{base}/"], options)
    assert [r["text"] for r in whole[0].collect()] == ["All of it."] and "whole text" in whole[1].first()["note"]
    assert api.extract(spark, [f"{base}/"], options=Options(crawl=True, delay_ms=0, no_llms_txt=True, depth=0)).first()["text"].startswith("# Root")
    site["/llms-full.txt"] = _page("Not found")
    assert api.extract(spark, [f"{base}/"], options=Options(crawl=True, delay_ms=0, depth=0)).first()["text"].startswith("# Root")


def test_replay_reads_with_the_options_on_record(spark, server, tmp_path):
    base, site = server
    options = Options(crawl=True, delay_ms=0, max_pages=2)
    lock = api.record(api.extract(spark, [f"{base}/docs/"], options=options), "n", [f"{base}/docs/"], options)
    lock.save(str(tmp_path / "lock.json"))
    again = Lock.load(str(tmp_path / "lock.json"))
    assert len(lock.documents) == 2 and api.replay(spark, again).isEmpty()
    site["/docs/"] = SITE["/docs/"].replace("word", "other")
    assert [tuple(r) for r in api.replay(spark, again).collect()] == [(f"{base}/docs/", "changed")]


def test_pages_to_look_at(spark, tmp_path):
    (tmp_path / "scan.pdf").write_bytes(b"%PDF")
    (tmp_path / "text.pdf").write_bytes(b"%PDF text")
    docs = {r["path"].rsplit("/", 1)[-1]: r for r in api.extract(spark, [str(tmp_path)], pdf=lambda data: "text" if b"text" in data else Paged("", [1, 2])).collect()}
    assert docs["scan.pdf"]["pages_needing_ocr"] == [1, 2] and docs["text.pdf"]["pages_needing_ocr"] == [] and docs["text.pdf"]["text"] == "text"
