import itertools

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions.terms import distinctive_terms
from lectern.functions.words import STOP_WORDS
from lectern.operators import chunking as K
from lectern.operators import evals as E
from lectern.operators import skills as S
from lectern.operators import snapshots as N

SKILL = "skill_id bigint, dir_name string, path string, name string, description string, license string, extra array<struct<key:string,value:string>>, body string"


def _skills(spark, rows):
    return spark.createDataFrame([(i, d, f"/{d}/SKILL.md", n, t, None, x, b) for i, d, n, t, x, b in rows], SKILL)


def test_words():
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) == 103


def test_terms(one):
    got = one(distinctive_terms, ["Use when the User --deploys-- PDF-files, Ünïx über 日本 ab", None, "", "same Same SAME"])
    assert [sorted(g) for g in got] == [sorted(["deploys", "pdf-files", "Ünïx", "über", "日本"]), [], [], []]


def test_frontmatter(one):
    texts = ["---\nname: a\ndescription: b\n  c\n- d\nX: \"y: z\"\nx: w\n---\nbody\n", "---\nname: a\n", "no", "﻿---\r\nname: 'q'\r\n---  \r\nrest", "---\n---\nb", None, ""]
    got = one(S.frontmatter, texts)
    assert [g["found"] for g in got] == [True, False, False, True, True, None, False]
    assert [tuple(f) for f in got[0]["fields"]] == [("name", "a"), ("description", "b c - d"), ("x", "y: z"), ("x", "w")] and got[0]["body"] == "body\n"
    assert got[1]["body"] == "---\nname: a\n" and [tuple(f) for f in got[3]["fields"]] == [("name", "q")] and got[3]["body"] == "rest"


def test_links(one):
    body = "See [a](references/a.md \"t\") and ![b](./img/b.png), `references/c.md`, references/d.md. (references/e/) [x]() ref\\erences"
    assert sorted(one(S.linked_paths, [body])[0]) == ["img/b.png", "references/a.md", "references/c.md", "references/d.md"]


def test_audit(spark):
    good = "Use when the user wants to turn invoices into ledgers with totals."
    rows = [
        (1, "fine", "fine", good, [], "see references/a.md"), (2, "bare", None, None, None, ""), (3, "short", "Short", "tiny", [], "x"), (4, "fine", "fine", good + " again", [], "w " * 3200),
        (5, "long", "long", "y" * 1025, [], "references/gone.md"), (5, "long", "long", "y" * 1025, [], "references/gone.md"),
    ]
    skills = _skills(spark, rows)
    refs = spark.createDataFrame([(1, "references/a.md", "text"), (1, "references/b.md", " \n"), (1, "references\\c.md", "t")], "skill_id bigint, path string, text string")
    got = {(r["skill_id"], r["rule"], r["severity"]) for r in S.audit(skills, refs).collect()}
    assert got == {
        (1, "orphan-reference", "note"), (1, "empty-reference", "warning"), (2, "no-frontmatter", "error"), (2, "no-description", "error"), (3, "description-too-short", "warning"),
        (3, "description-not-routable", "warning"), (3, "name-mismatch", "warning"), (3, "name-not-kebab-case", "warning"), (4, "body-over-budget", "error"), (4, "no-progressive-disclosure", "note"),
        (5, "description-too-long", "error"), (5, "description-not-routable", "warning"), (5, "broken-reference-link", "error"), (1, "trigger-overlap", "warning"), (4, "trigger-overlap", "warning"),
    }
    tree = sorted(map(tuple, S.tree_findings(skills).collect()))
    assert tree == [("duplicate-name", "error", "fine"), ("trigger-overlap", "warning", "1,4")]
    total = dict(S.totals(S.audit(skills, refs), S.tree_findings(skills)).collect())
    assert total["error"] == 6 and not S.passes(S.totals(S.audit(skills, refs), S.tree_findings(skills))).first()[0]
    none = _skills(spark, [])
    assert S.audit(none, refs.limit(0)).count() == 0 and S.tree_findings(none).count() == 0


def test_overlap_against_all_pairs(spark):
    words = [f"term{i}" for i in range(14)]
    texts = [" ".join(words[(i * k) % 14] for k in range(1, 3 + i % 9)) for i in range(60)]
    got = {(r[0], r[1]): r[2] for r in S.trigger_overlap(_skills(spark, [(i, "d", "n", t, [], "") for i, t in enumerate(texts)])).collect()}
    sets = [set(t.split()) for t in texts]
    want = {(i, j): len(sets[i] & sets[j]) for i, j in itertools.combinations(range(60), 2) if min(len(sets[i]), len(sets[j])) >= 3 and len(sets[i] & sets[j]) >= 3 and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.34}
    assert got == want
    plan = S.trigger_overlap(_skills(spark, [(1, "d", "n", "t", [], "")]))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sections_and_packs():
    text = "intro\n# One\nsource: u\nbody\n```\n# not\n```\n#  \n# Two\nsource: u\nmore\n# Blank\n\n# Three\nend"
    parts = K.sections(text)
    assert [(t, o) for t, o, _ in parts] == [("Opening", None), ("One", "u"), ("Two", "u"), ("Three", None)]
    packed = K.pack(parts)
    assert [p[0] for p in packed] == ["Opening", "One + Two", "Three"] and "\n\n# Two\n\n" in packed[1][2]
    assert K.sections("") == [] and K.sections(" \n") == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab", min_size=1, max_size=3), st.sampled_from([None, "u", "v"]), st.text(alphabet="wx \n", min_size=1, max_size=40)), max_size=12))
def test_packs_hold_their_budget(parts):
    packed = K.pack(parts, 8)
    assert sum(len(p[0].split(" + ")) for p in packed) == len(parts)
    assert all(len(p[0].split(" + ")) == 1 or sum(K.estimate(b) for b in [p[2]]) <= 8 + 8 for p in packed)


def test_file_blocks(spark):
    ok = "x\n=== FILE: `a.md` ===\n1\n=== FILE: b\\c.md ===\n2\n=== FILE: d ===\n \n"
    rows = [(1, ok), (2, "none"), (3, "=== FILE: /etc/x ===\n1"), (4, None)]
    got = sorted(map(tuple, K.file_blocks(spark.createDataFrame(rows, "k int, reply string"), "k").collect()), key=str)
    assert got == [(1, "a.md", "1\n", None), (1, "b/c.md", "2\n", None), (2, None, None, "no file blocks"), (3, None, None, "outside the folder: /etc/x"), (4, None, None, "no file blocks")]


def test_grades(spark):
    rows = [(1, "#1: PASS — right value\n2: fail - wrong\n2: PASS\n9: PASS\nx: PASS\n 3 : Passable", 4), (2, None, 1), (3, "1: PASS", 0)]
    got = sorted(map(tuple, E.grades(spark.createDataFrame(rows, "k int, r string, n int"), "k", "r", "n").collect()))
    assert got == [(1, 1, True, "right value"), (1, 2, True, ""), (1, 3, True, ""), (1, 4, False, E.SILENT), (2, 1, False, E.SILENT)]


def test_examination(spark, one):
    assert one(E.json_array, ["```[1, [2]]``` x", "none", "]["]) == ["[1, [2]]", None, None]
    assert one(E.api_error_message, ['{"error": {"message": "m"}}', "plain", "", None]) == ["m", "plain", "no message", "no message"]
    assert E.batches(12) == [3, 3, 3, 3] and E.batches(7) == [3, 3, 1] and E.batches(0) == []
    text = "\n".join(f"line {i}" for i in range(10))
    cut = E.excerpts_of(text, 3)
    assert len(cut) == 3 and "".join(cut).count("line") == 10 and E.excerpts_of("", 3) == []
    graded = spark.createDataFrame([("a", True, "s"), ("a", False, "z"), ("a", False, "b"), ("a", False, " ")], "g string, passed boolean, section string")
    assert tuple(E.report(graded, "g").first()) == ("a", 4, 1, ["b", "z"], 0.25)


def test_snapshots(spark):
    k = "key string, content_hash string, estimated_tokens bigint"
    before, after = spark.createDataFrame([("a", "1", 5), ("b", "1", 5), ("c", None, 0)], k), spark.createDataFrame([("b", "2", 6), ("c", None, 0), ("d", "1", 1)], k)
    assert sorted(map(tuple, N.changes(before, after).collect())) == [("a", "removed"), ("b", "changed"), ("d", "added")]
    assert N.changes(before, before).count() == 0
    assert N.summary(before, after).first().asDict() == {"was_tokens": 10, "now_tokens": 7, "added": 1, "removed": 1, "changed": 1, "moved": True}
    many = spark.range(25).select(F.format_string("%03d", "id").alias("key"), F.lit("added").alias("change"))
    shown = N.shown(many).orderBy("place").collect()
    assert len(shown) == 21 and shown[-1]["key"] == "... and 5 more"
    assert N.changelog("b", N.changelog("a", "")).count("# Changelog") == 1
