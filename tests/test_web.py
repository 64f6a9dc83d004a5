import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import html as H
from lectern.functions import urls as U
from lectern.operators import crawl as W
from lectern.operators import sources as S

PAGES = [
    "<p>a</p><p>b</p>", "x<br>y<br/>z", "<pre>  if x:\n    y</pre> after", "<pre></pre>", "&lt;b&gt; &amp;lt; &#65;&#x42; &#xD800; &#99999999; &nope;", "<h1>T<a>¶</a></h1>",
    "<!-- c --><script>var a='<p>'</script><style>p{}</style>t", "", " \n\n\n\n a \n\n\n\n b ", "<div>a<div>b</div></div>", "no tags", "\ue000 mark", "<pre>one</pre><pre>two</pre>\n<pre>\n</pre>z",
]


def test_strip(one):
    got = one(H.strip, PAGES + [None])
    assert got == [H.strip_text(p) for p in PAGES] + [None]
    assert got[0] == "a\nb" and got[2] == "```\n  if x:\n    y\n```\n after".replace("\n after", "\nafter") and got[4] == "<b> &lt; AB &#xD800; &#99999999; &nope;"


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="<>/pre&;#x41 \nabcdiv!-", max_size=60))
def test_strip_model_is_total(t):
    assert isinstance(H.strip_text(t), str) and isinstance(H.content(t), str)


def test_title_and_links(one):
    assert one(H.title, ["<title> A \n b</title><h1>c</h1>", "<h1>c</h1>", "<title></title><h1>c</h1>", "x"]) == ["A b", "c", None, None]
    assert one(H.links, ["""<a href="x?a=1&amp;b=2">1</a><A class=k href='y'>2</a><a href=z>3</a><a name=n>4</a>"""]) == [["x?a=1&b=2", "y", "z"]]


def test_main_content():
    body = "word " * 60
    page = f"<html class='sidebar-visible'><body><nav>menu</nav><main>stub</main><article><p>{body}</p><div class='my-toc'>toc</div></article><footer>foot</footer></body></html>"
    text = H.strip_text(H.content(page))
    assert "word" in text and "menu" not in text and "foot" not in text and "toc" not in text
    nested = f"<body><div class='prose'><div>{body}</div>tail</div>after</body>"
    assert H.strip_text(H.content(nested)).endswith("tail")
    assert H.content("<nav>all</nav>" + "x" * 3) and H.drop_chrome("<nav>" + "y" * 500 + "</nav>z").startswith("<nav>")
    assert H.content("<p>protocol class</p>") == "<p>protocol class</p>"


URLS = {
    "http://Ex.ample:8080/a/./b/../c?q=1#f": ("http", "ex.ample", 8080, "/a/c", "q=1"), "https://h": ("https", "h", None, "/", None), "https://u:p@h/x/": ("https", "h", None, "/x/", None),
    "ftp://h/": None, "https://": None, "https://h:99999/": None, "https://[::1]:80/a": ("https", "[::1]", 80, "/a", None), "https://h/?": ("https", "h", None, "/", None), "nothing": None, "https://h//a//": ("https", "h", None, "/a/", None),
}


def test_parse(one):
    got = one(U.parse, list(URLS))
    assert [None if g is None else tuple(g) for g in got] == list(URLS.values())
    again = one(lambda c: U.render(U.parse(U.render(U.parse(c)))), list(URLS))
    assert again == one(lambda c: U.render(U.parse(c)), list(URLS))


def test_join(one):
    base = F.lit("https://h/docs/a/b.html?z")
    refs = {
        "c": "https://h/docs/a/c", "../c": "https://h/docs/c", "/r": "https://h/r", "?q": "https://h/docs/a/b.html?q", "//o/x": "https://o/x", "http://p/": "http://p/", "mailto:a@b": None,
        "#t": None, "": None, "javascript:x": None, "ftp://x/y": None, "word:rest": None, "a/b:c": "https://h/docs/a/a/b:c",
    }
    assert one(lambda c: U.render(U.join(U.parse(base), c)), list(refs)) == list(refs.values())


def test_url_predicates(one):
    u = ["https://h/d/a.html?x", "https://h/d/?x", "https://h/d/a?x", "https://h/a.PNG", "https://h/"]
    assert one(lambda c: U.render(U.without_decoration(U.parse(c))), u) == ["https://h/d/a.html", "https://h/d/", "https://h/d/a?x", "https://h/a.PNG", "https://h/"]
    assert one(lambda c: U.looks_like_a_page(U.parse(c)), u) == [True, True, True, False, True]
    assert one(U.parent, ["/a/b/", "/a", "/"]) == ["/a/", "/", None]


@pytest.mark.parametrize(
    ("body", "path", "want"),
    [
        ("", "/x", True), ("User-agent: *\nDisallow: /a", "/a/b", False), ("User-agent: *\nDisallow: /\nUser-agent: lectern\nDisallow: /b", "/a", True), ("User-agent: *\nDisallow: /a\nAllow: /a/b", "/a/b/c", True),
        ("User-agent: *\nDisallow:", "/x", True), ("User-agent: *\nDisallow: /*.json$", "/a.json", False), ("User-agent: *\nDisallow: /*.json$", "/a.json/b.json", True), ("User-agent: *\nAllow: /p\nDisallow: /p", "/p", True),
    ],
)
def test_robots(body, path, want):
    assert W.allowed(W.robots_rules(body), path) is want


def test_breadth_first(spark):
    links = [("c", "a", 0, "b"), ("c", "a", 1, "d"), ("c", "b", 0, "a"), ("c", "b", 1, "e"), ("c", "d", 0, "e"), ("c", "e", 0, "f"), ("x", "q", 0, "q")]
    got = W.breadth_first(spark.createDataFrame([("c", "a"), ("x", "q")], "crawl string, page string"), spark.createDataFrame(links, "crawl string, source string, ordinal int, target string"), 2, 4)
    assert sorted(map(tuple, got.collect())) == [("c", "a", 0, 1), ("c", "b", 1, 2), ("c", "d", 1, 3), ("c", "e", 2, 4), ("x", "q", 0, 1)]


def test_classify(one):
    want = {
        "https://github.com/o/r": ("repo", "https://github.com/o/r.git", None, None, "o/r"), "https://github.com/o/r/tree/dev/a/b": ("repo", "https://github.com/o/r.git", "dev", "a/b", "o/r"),
        "gh:o/r@x": ("repo", "https://github.com/o/r.git", "x", None, "o/r"), "o/r": ("repo", "https://github.com/o/r.git", None, None, "o/r"), "git@h:o/r.git": ("repo", "git@h:o/r.git", None, None, "r"),
        "a/b.md": ("file", "a/b.md", None, None, None), "": ("error", "", None, None, None), "gh:o": ("error", "o", None, None, None), "https://e.example/x#y": ("web", "https://e.example/x", None, None, None),
    }
    got = one(S.classify, list(want))
    assert [tuple(g)[:5] for g in got] == list(want.values())


def test_repo_files(spark, one):
    assert one(lambda c: S.glob_matches(c, "docs/**/*.md"), ["docs/a.md", "docs/x/a.MD", "src/a.md", "docs/a_md"]) == [True, True, False, False]
    assert one(S.reading_rank, ["README.md", "docs/a.md", "x/readme.txt", "y.md"]) == [0, 1, 2, 3]
    files = [("r", "b.md"), ("r", "README.md"), ("r", "node_modules/x.md"), ("r", ".git/a.md"), ("r", "a.rs"), ("r", "docs/z.md")]
    got = S.repo_select(spark.createDataFrame(files, "repo string, file string"), "repo", "file", most=2).collect()
    assert sorted((r["place"], r["file"], r["dropped"]) for r in got) == [(1, "README.md", 1), (2, "docs/z.md", 1)]
    assert one(S.route, ["PDF", "md", "azw3", "docx", "exe", None]) == ["pdf", "text", "kindle", "office", None, None]
    assert len(S.formats()) == 34
