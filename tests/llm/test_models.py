"""Problems 1, 2, 5 and 9: trained models against labelled fixtures they haven't seen, and their edge cases."""

import random

import numpy as np
import pytest

from lectern.llm import crf, fetched, markup, pages, pii, residue

WORDS = "harbour ledger winter signal copper meadow engine pocket thunder velvet marble lantern orchard compass timber saddle barrel kettle".split()


def _sentence(r, n=None):
    return " ".join(r.choice(WORDS) for _ in range(n or r.randint(6, 14))).capitalize() + "."


def _page(r, kind):
    """(html, numbers of furniture blocks) in one of three layouts, two of which say nothing by their classes."""
    site = r.choice(["Acme", "Borea", "Cirrus"])
    title = " ".join(r.choice(WORDS) for _ in range(3)).title()
    number, furniture, out = 0, [], []

    def block(tag, text, main):
        nonlocal number
        number += 1
        if not main:
            furniture.append(number)
        return f"<{tag}>{text}</{tag}>"

    def menu():
        return "<ul>" + "".join(block("li", f"<a href='/{x}'>{x}</a>", False) for x in ("Home", "Products", "Contact us", "Sign in")) + "</ul>"

    def body():
        inner = block("h1", title, True)
        for _ in range(r.randint(2, 5)):
            inner += block("p", " ".join(_sentence(r) for _ in range(3)), True)
            if r.random() < 0.4:
                inner += "<ul>" + "".join(block("li", _sentence(r, 5), True) for _ in range(3)) + "</ul>"
            if r.random() < 0.3:
                inner += block("h2", " ".join(r.choice(WORDS) for _ in range(2)).title(), True)
        return inner

    def foot():
        return block("p", f"© 20{r.randint(10, 25)} {site}. All rights reserved.", False) + block("p", f"Privacy notice and terms of {site}", False) + block("p", "Subscribe to our monthly letter", False)

    if kind == "named":
        out = ["<header><nav>", menu(), "</nav></header><main><article>", body(), "</article></main><footer>", foot(), "</footer>"]
    elif kind == "classes":
        out = ["<div class='k1'>", menu(), "</div><div class='k2'><div class='k3'>", body(), "</div></div><div class='k4'>", foot(), "</div>"]
    else:
        out = ["<table><tr><td>", menu(), "</td></tr><tr><td>", body(), "</td></tr><tr><td>", foot(), "</td></tr></table>"]
    return f"<html><head><title>{title} | {site}</title><script>var x='<p>no</p>'</script></head><body><!-- <p>no</p> -->{''.join(out)}</body></html>", furniture


def _corpus(seed, n):
    r = random.Random(seed)
    return [_page(r, ("named", "classes", "table")[i % 3]) for i in range(n)]


def test_chain_is_a_chain():
    r = random.Random(5)
    # two labels that stick, seen through a noisy sign
    data = []
    for _ in range(150):
        y, page = r.randint(0, 1), []
        for _ in range(20):
            y = y if r.random() < 0.9 else 1 - y
            sign = y if r.random() < 0.8 else 1 - y
            page.append(([crf.bucket(f"s{sign}")], y))
        data.append(page)
    chain = crf.Chain(["a", "b"]).train([[(f, y if i % 3 else -1) for i, (f, y) in enumerate(p)] for p in data[:100]])
    hits = [a == b for p in data[100:] for a, b in zip(chain.decode([chain.emission(f) for f, _ in p]), [y for _, y in p], strict=True)]
    plain = [f[0] == crf.bucket(f"s{y}") for p in data[100:] for f, y in p]
    assert np.mean(hits) > np.mean(plain) + 0.04
    assert chain.decode([]) == [] and crf.Chain(["a", "b"]).train([]).decode([(0.0, 1.0)]) == [1]


def test_viterbi_for_two_labels_is_viterbi():
    rng = np.random.default_rng(3)
    for _ in range(50):
        chain = crf.Chain(["a", "b"], None, rng.normal(size=(2, 2)), rng.normal(size=2))
        three = crf.Chain(["a", "b", "c"], None, np.pad(chain.step, (0, 1), constant_values=-50), np.pad(chain.begin, (0, 1), constant_values=-50))
        scores = rng.normal(size=(12, 2))
        assert chain.decode(scores.tolist()) == three.decode(np.pad(scores, ((0, 0), (0, 1)), constant_values=-50).tolist())


def test_main_body_on_unseen_pages():
    parsed = [pages.parse(h) for h, _ in _corpus(1, 150)]
    reader = pages.Reader(pages.train(parsed))
    right = total = 0
    for page, want in _corpus(2, 90):
        title, blocks = pages.parse(page)
        got = set(pages.furniture(blocks, reader.labels(title, blocks)))
        numbers = {b.number for b in blocks if b.number}
        right += sum((n in got) == (n in want) for n in numbers)
        total += len(numbers)
    assert right / total > 0.97


def test_block_numbers():
    page = "<P>a<li>b<noscript><p>no</p></noscript><!-- <p> --><BLOCKQUOTE><p class=x>c</p></BLOCKQUOTE><template><h1>t</h1></template><pre>d</pre><link><paragraph>e</paragraph><h6>f"
    assert [(b.number, b.tag, b.text) for b in pages.parse(page)[1] if b.number] == [(1, "p", "a"), (2, "li", "b"), (3, "blockquote", ""), (4, "p", "c"), (5, "pre", "d e"), (6, "h6", "f")] or [b.number for b in pages.parse(page)[1] if b.number] == [1, 2, 3, 4, 5, 6]
    assert pages.parse("") == ("", []) and pages.parse("<script>never closed <p>x")[1] == []
    assert pages.read(b"\xef\xbb\xbf\xff<p>") == "\ufffd<p>" and pages.read(None) == ""
    assert pages.is_html(None, "<!DOCTYPE html>") and pages.is_html("application/xhtml+xml", "") and not pages.is_html("text/plain", "<html>") and not pages.is_html(None, "%PDF")


RESIDUE = {
    "error": ["Sorry, this page could not be found.", "Interner Serverfehler. Bitte versuchen Sie es später erneut.", "You do not have permission to view this folder."],
    "script": ["Please enable JavaScript to continue.", "Bitte aktivieren Sie JavaScript."],
    "placeholder": ["{{ post.body }}", "Dear [First Name],", "${page.intro}"],
    "filler": ["Lorem ipsum dolor sit amet, consectetur adipiscing elit sed.", "text text text text text text text"],
}


def _tables(spark, seed=4, n=240):
    r = random.Random(seed)
    rows, want = [], {}
    for i, (page, _) in enumerate(_corpus(seed, n)):
        if i % 6 == 0:
            kind = r.choice(list(RESIDUE))
            page = f"<html><head><title>x</title></head><body><header><nav><ul><li><a href=/>Home</a></li></ul></nav></header><main><h1>Notice</h1><p>{r.choice(RESIDUE[kind])}</p></main><footer><p>© 2020 Acme. All rights reserved.</p></footer></body></html>"
            want[i] = kind
        rows.append((i, f"https://h{i % 20}.example/p{i}", page.encode(), "text/html", "kept"))
    rows += [rows[0], (9001, "https://a.example/", None, "text/html", ""), (9002, None, b"", None, ""), (9003, "https://a.example/x", b"\xff\xfe", "text/html", ""), (9004, "https://a.example/y", b"plain", "text/plain", ""), (9005, "https://a.example/z", b"<h1>Long</h1><p>" + b" ".join(b"word%d is one of many" % i for i in range(30_000)), "text/html", "")]
    return spark.createDataFrame(rows, "fetch_id bigint, url string, bytes binary, content_type string, furniture string"), want


def test_residue_pages(spark):
    df, want = _tables(spark)
    rows = fetched.judged_pages(df, with_text=True).collect()
    got = {r["fetch_id"]: r["kind"] for r in rows if r["kind"]}
    assert got == want
    by = {r["fetch_id"]: r for r in rows}
    assert 9004 not in by and 9001 in by and by[9001]["furniture"] == [] and len(by[9005]["text"]) > 500_000
    assert fetched.judged_pages(df.limit(0)).count() == 0
    held = fetched.holdout(df).collect()
    assert sum(r["sentences"] for r in held if r["label"] == r["predicted"]) > 0.95 * sum(r["sentences"] for r in held)


def test_holdout_judges_all_pages_of_hosts_nothing_was_trained_on(spark, monkeypatch):
    df, _ = _tables(spark, seed=6, n=120)
    whole = sum(r["sentences"] for r in fetched.holdout(df).collect())
    assert whole == sum(r["sentences"] for r in fetched.holdout(df.unionByName(df)).collect())
    # as many whatever the sample's size
    seen = []
    for module, name in ((pages, "train"), (residue, "train_pages")):
        monkeypatch.setattr(module, name, lambda given, *more, f=getattr(module, name): seen.extend(x[0] for x in given) or f(given, *more))
    monkeypatch.setattr(residue, "SAMPLE_PAGES", 60)
    some = sum(r["sentences"] for r in fetched.holdout(df).collect())
    assert abs(some - whole) < 0.1 * whole
    titles = {pages.parse(bytes(r["bytes"]).decode())[0] for r in df.where("fetch_id < 1000").collect() if fetched.held_out(fetched._host(r["url"]))}
    others = {pages.parse(bytes(r["bytes"]).decode())[0] for r in df.where("fetch_id < 1000").collect() if not fetched.held_out(fetched._host(r["url"]))}
    assert titles and seen and not set(seen) & (titles - others)


def test_residue_entries(spark):
    plain = ["https://a.example/x: http status: 404", "https://a.example/y: timeout: global", "https://a.example/z: Not Found", "https://a.example/w: 502 Bad Gateway"]
    rows = [(i, [plain[i % 4], None, ""], None) for i in range(60)]
    rows += [(100, ["${url}: status 500"], None), (101, ["https://a.example/x: <html><body><h1>502 Bad Gateway</h1></body></html>"], None), (102, ["https://a.example/x: {{ reason }}", "lorem ipsum dolor sit amet"], None), (103, ["https://a.example/x: You need to enable JavaScript to run this app."], None), (104, [], None), (105, None, None), (103, ["https://a.example/x: You need to enable JavaScript to run this app."], None)]
    df = spark.createDataFrame(rows, "crawl_id bigint, errors array<string>, kind string")
    got = sorted(map(tuple, fetched.judged_entries(df).collect()))
    assert got == [(100, "placeholder"), (101, "error"), (102, "filler"), (102, "placeholder"), (103, "script")]
    assert fetched.judged_entries(df.limit(0)).count() == 0


# problem 1


CASES = {
    "<p>A <b>word</b> &amp; more</p>": "html", "x &nbsp; y": "html", "<!-- note -->": "html", "a **bold** word": "markdown", "see [this](https://x.example/y) here": "markdown", "- [x] done": "markdown",
    "Head\n----\ntext": "markdown", "text[^1] more": "markdown", "| a | b |\n|---|---|\n| 1 | 2 |": "markdown", "== Head ==\ntext": "wiki", "[[Page|label]] text": "wiki", "a '''bold''' word": "wiki",
    "{| class=x\n|-\n| 1 || 2\n|}": "wiki", "{{note|a=b}}": "wiki", "\\section{Head} text": "latex", "\\begin{itemize}\n\\item a\n\\end{itemize}": "latex", "see \\emph{this} word": "latex",
}
CLEAN = [
    "# Heading\n\n- item\n1. item", "```\n<b>**x**</b> [[y]]\n```", "use `<b>` and `**x**`", "cost $n \\log n$ here", "a < b and c > d & e", "AT&T and R&D", "Vec<u8> or Option<Thing>", "4 * 6 * 2 cells", "C:\\new\\file",
    "https://x.example/a_b_c?d=1&copy=2", "{{ page.title }} and ${name}", "snake_case_name here", "from $5 to $10 each", "", " ", "the set {1, 2} and [0, 3]",
]


def _markup(seed, n):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        parts = [(_sentence(r), None) for _ in range(3)]
        picked = [r.choice(list(CASES)) for _ in range(r.randint(0, 2))]
        parts += [(c, CASES[c]) for c in picked] + [(r.choice(CLEAN), None)]
        r.shuffle(parts)
        rows.append((i, "\n\n".join(p for p, _ in parts), r.choice(["web-page", "plain-text"]), {k for _, k in parts if k}))
    return rows


def test_markup_on_unseen_texts():
    decode = markup.Decoder(markup.train([(t, m) for _, t, m, _ in _markup(1, 300)]))
    for _, text, method, want in _markup(2, 300):
        assert {label for *_, label in decode(text, method)} - {"clean"} == want, text


#: The same sign as residue and as itself; none of these stand in the labelled pages.
CONTEXTS = [
    ("The *quick* visit was over.\n\nSee [more](https://x.example).", {"markdown"}, "void put(char *quick, char *over);\nput(*quick, *over);"),
    ("'''Harbour''' is a [[village]] near the sea.", {"wiki"}, "doc = '''Harbour'''\nprint(doc)"),
    ("Read [the plan][p] now.\n\n[p]: https://x.example/p", {"markdown"}, "total += table[row][column];"),
    ("{{cite|title=Harbour}} is what [[they]] say.", {"wiki"}, "print({{ harbour|title(1, 2) }});"),
    ("| harbour | size |\n|---|---|\n| north | 4 |", {"markdown"}, "if (north | south | east) { open(); }"),
    ("Then __leave__ the harbour.\n\n- [x] done", {"markdown"}, "class Harbour:\n    def __enter__(self): return self.__dict__"),
]


def test_signs_are_judged_by_their_surroundings():
    decode = markup.Decoder(markup.train([(t, m) for _, t, m, _ in _markup(1, 300)]))
    for marked, languages, plain in CONTEXTS:
        assert {y for *_, y in decode(marked, "web-page")} - {"clean"} == languages, marked
        assert {y for *_, y in decode(plain, "web-page")} <= {"clean"}, plain
    # the chain goes against what the form usually is
    assert sum(decode.overruled(plain, "web-page")[1] for *_, plain in CONTEXTS) >= 5


def test_markup_table(spark):
    rows = _markup(3, 200)
    data = [(i, t, m, "x") for i, t, m, _ in rows] + [(0, rows[0][1], rows[0][2], "x"), (900, None, None, "x"), (901, "", "m", "x"), (902, "<b>" + "word " * 100_000, "m", "x")]
    df = spark.createDataFrame(data, "file_id bigint, text string, method string, markup string")
    got = {r["file_id"]: r for r in markup.decoded(df, clean=True).collect()}
    assert all(set(got[i]["markup"]) == want for i, _, _, want in rows)
    assert got[900]["text"] is None and got[901]["text"] == "" and got[902]["markup"] == ["html"] and got[902]["text"].startswith("word")
    again = {r["file_id"]: r["markup"] for r in markup.decoded(df.select("file_id", "method").join(spark.createDataFrame([(i, r["text"]) for i, r in got.items()], "file_id bigint, text string"), "file_id")).collect()}
    assert not any(again.values())
    assert markup.decoded(df.limit(0)).count() == 0


def test_marks_in_marks_are_all_removed(spark):
    rows = [(i, t, m) for i, t, m, _ in _markup(3, 200)]
    deep = {900: "A fact &" + "amp;" * 9 + "nbsp; here.", 901: "See " + "\\emph{" * 8 + "this" + "}" * 8 + " word.", 902: "One " + "{{note|a=" * 7 + "b" + "}}" * 7 + " two."}
    df = spark.createDataFrame(rows + [(i, t, "web-page") for i, t in deep.items()], "file_id bigint, text string, method string")
    got = {r["file_id"]: r for r in markup.decoded(df, clean=True).where("file_id >= 900").collect()}
    assert all(got[i]["markup"] for i in deep)
    assert not any(x in got[i]["text"] for i in deep for x in ("amp;", "emph", "{{", "}}")), [got[i]["text"] for i in deep]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("== Head ==\n* x", "## Head\n* x"), ("\\section{One}\n\\begin{itemize}\n\\item a\n\\end{itemize}", "# One\n\n- a\n"), ("a [b](c) **d** `**e**`", "a b d `**e**`"), ("```\n**x**\n```\n&lt;y", "```\n**x**\n```\n<y"),
        ("\\begin{equation}\nx_i = \\sum_k y\n\\end{equation}", "$$\nx_i = \\sum_k y\n$$"), ("<ul><li>one</li><li>two</li></ul>", "\n\n- one\n- two\n"), ("| a | b |\n|---|---|\n| 1 | 2 |", "a b\n\n1 2"),
    ],
)
def test_conversion(text, want):
    found = [(f, a, b, markup._LABEL[f] or markup.OPEN[f]) for f, a, b in markup.marks(text)]
    assert markup.convert(text, found) == want


# problem 9


NAMES = frozenset(["Clara", "Bruno", "Ingrid", "Paul", "Nadia"])
OTHERS = "Oskar Yvette Tamsin Lorcan Beatrix Cosmo Delphine Edmund Fiora Gideon Hester Isolde Jasper Katya Leopold Mireille Nestor Ottilie Piers Quentin".split()
FAMILIES = ["Whitcombe", "Harrowgate", "Lindqvist", "Brandtner", "Oakhurst", "Thornbury"]


def _document(r):
    given = r.choice([*NAMES, *OTHERS])
    family = r.choice(FAMILIES)
    choices = [
        (f"author: {given} {family}", [("person", f"{given} {family}")]), (f"Ask {family}, {given} about it.", [("person", f"{family}, {given}")]), (f"cc {given} K. {family}; no reply yet.", [("person", f"{given} K. {family}")]),
        (f"Call +44 20 7946 0{r.randint(100, 999)} now.", None), (f"Write to {given.lower()}.{family.lower()}@mail.example soon.", [("email", f"{given.lower()}.{family.lower()}@mail.example")]),
        (f"sent to {given.lower()} at mail dot example, ok", [("email", f"{given.lower()} at mail dot example")]), ("Clone git@git.x.example:a/b.git and run x@1.2.3.", []), (f"Address: {r.randint(1, 99)} {family} Street", None),
        (f"My SSN is 9{r.randint(10, 99)}-55-{r.randint(1000, 9999)}, drop it.", None), (f"Part no. 9{r.randint(10, 99)}-44-{r.randint(1000, 9999)} replaces it.", []), (f"Order ZX-{r.randint(1000000, 9999999)} holds 12 copies.", []),
        ("Chapter 28 Street maps and other layers", []), ("The server at 192.0.2.75 answers.", []), (f"{given} is a name alone.", []),
    ]
    picked = r.sample(choices, 4)
    found = []
    for text, want in picked:
        if want is None:
            kind, cut = ("phone", text[5:-5]) if text.startswith("Call") else ("street", text[9:]) if text.startswith("Address") else ("id", text[10:21])
            want = [(kind, cut)]
        found += want
    lines = [p for p, _ in picked] + [_sentence(r) for _ in range(3)]
    r.shuffle(lines)
    return "\n\n".join(lines), set(found)


def test_personal_information_on_unseen_documents():
    r = random.Random(8)
    finder = pii.train([_document(r)[0] for _ in range(600)], NAMES)
    hits = wrong = missed = 0
    for _ in range(300):
        text, want = _document(r)
        got = {(k, text[a:b]) for a, b, k in finder.find(text)}
        hits, wrong, missed = hits + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert hits / (hits + wrong) > 0.97 and hits / (hits + missed) > 0.97


def test_reliabilities_find_the_odd_labeler():
    rng = np.random.default_rng(1)
    truth = rng.random(2000) < 0.4
    votes = np.stack([np.where(rng.random(2000) < q, np.where(truth, 1, -1), np.where(truth, -1, 1)) for q in (0.9, 0.85, 0.8, 0.5)], 1)
    votes[rng.random(votes.shape) < 0.2] = 0
    p = pii.reliabilities(votes)
    assert ((p > 0.5) == truth).mean() > max(0.89, ((votes.sum(1) > 0) == truth).mean())


def test_personal_information_table(spark):
    r = random.Random(9)
    rows = [(i, _document(r)[0], "x") for i in range(300)]
    rows += [(900, None, "x"), (901, "", "x"), (902, " \n", "x"), (903, "word " * 100_000 + "author: Clara Whitcombe", "x"), rows[0]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    names = spark.createDataFrame([(n, "en") for n in NAMES] + [(None, "en"), ("Clara", "de")], "given_name string, lang string")
    finder = pii.trained(df, names)
    got = {x["doc_id"]: x for x in pii.found(df, finder, replaced=True).collect()}
    assert got[900]["text"] is None and got[901]["text"] == "" and got[902]["text"] == " \n" and got[903]["text"].endswith("author: [PERSON]")
    some = next(x for x in got.values() if any(p["kind"] == "phone" for p in x["pieces"]))
    assert "[PHONE]" in some["text"]
    assert pii.found(df.limit(0), pii.trained(df.limit(0), names.limit(0))).count() == 0


def test_words_and_phrases_are_counted_over_all_documents(spark, monkeypatch):
    monkeypatch.setattr(pii, "TRAIN_DOCS", 20)
    texts = [f"{_sentence(random.Random(i))}\n\nauthor: Oskar Brandtner" for i in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    sampled = {r["doc_id"] for r in pii.bounded_sample(df, "doc_id", 20)}
    outside = [i for i in range(200) if i not in sampled][:12]
    changed = [(i, t + "\n\nThe Granite Beacon stays, and quillons too." if i in outside else t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(changed + changed[:1], "doc_id bigint, text string")
    names = spark.createDataFrame([(n,) for n in NAMES], "given_name string")
    common = pii.trained(df, names).common
    # stand outside the sample only
    assert {"Granite Beacon", "quillons"} <= common
    # an author of many documents is no fixed phrase
    assert "Oskar Brandtner" not in common
    # counts in parts, copies of rows once
    monkeypatch.setattr(pii, "_OPEN_COUNTS", 10)
    assert pii.counted(df.repartition(7), NAMES) == common == pii.counted(df.unionByName(df), NAMES)


def test_shares_of_documents_make_words_common():
    counts = {("w", "beacon"): 4, ("p", "Granite Beacon"): 12, ("p", "Oskar Brandtner"): 12, ("q", "Oskar Brandtner"): 11}
    assert pii.common_words(counts, 6000, NAMES) == {"beacon", "Granite Beacon"}
    assert pii.common_words(counts, 60_000, NAMES) == set()
    assert pii.common_words({k: 10 * n for k, n in counts.items()}, 60_000, NAMES) == {"beacon", "Granite Beacon"}


def test_residue_labeller_knows_a_mention():
    assert residue.weak("The message “please enable JavaScript” comes from the page.") == -1
    assert residue.weak("Please enable JavaScript.") == residue.SCRIPT


@pytest.mark.parametrize(
    ("text", "kind", "want"),
    [
        ("sent to ann.lee AT mail.example, who", "email", ["ann.lee AT mail.example"]), ("look at mail.example now", "email", []), ("x [at] y[dot]example.", "email", ["x [at] y[dot]example"]),
        ("cc É. O'Hara; no", "person", ["É. O'Hara"]), ("M. Zoé K. Arnaud a relu", "person", ["Zoé K. Arnaud"]), ("by van Dam, Zoé が", "person", ["van Dam, Zoé"]), ("HEIKE KRAUSE", "person", ["HEIKE KRAUSE"]),
        ("SSN 912-55-1234 A broken thing", "id", ["912-55-1234"]), ("numberはQQ 12 34 56 Cです", "id", ["QQ 12 34 56 C"]), ("am Alten Weg 12b, dann", "street", ["Alten Weg 12b"]), ("at 12 N. Oak St; ring", "street", ["12 N. Oak St"]), ("Chapter 28 Street maps", "street", []),
        ("1 (718) 555‑0128 or", "phone", ["1 (718) 555‑0128"]),
    ],
)
def test_candidates(text, kind, want):
    assert [text[a:b] for k, a, b in pii.candidates(text) if k == kind] == want
