import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern import api, model, server
from lectern.sources import tables
from lectern.sources.readers import read_files, read_skills
from lectern.streaming.refresh import refresh_stream


def _zip(path, files):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.txt").write_bytes(b"plain \xff text")
    (tmp_path / "b.html").write_text("<nav>menu</nav><p>x</p>")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    _zip(tmp_path / "c.docx", {"word/document.xml": f"<w:document xmlns:w='{w}'><w:body><w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Bo</w:t></w:r><w:r><w:t>dy</w:t></w:r></w:p></w:body></w:document>"})
    (tmp_path / "d.csv").write_text("k,v\n1,2\n")
    (tmp_path / "e.docx").write_bytes(b"broken")
    (tmp_path / "f.pdf").write_bytes(b"%PDF")
    (tmp_path / "g.exe").write_bytes(b"MZ")
    (tmp_path / "h.mobi").write_bytes(b"x")
    return tmp_path


def test_read_files(spark, folder):
    got = {r["path"].rsplit("/", 1)[1]: r for r in read_files(spark, str(folder)).collect()}
    assert got["a.txt"]["text"] == "plain � text" and got["b.html"]["text"] == "menux"
    assert got["c.docx"]["text"] == "# Head\n\nBody" and got["d.csv"]["text"] == "| k | v |\n| 1 | 2 |"
    assert all(got[n]["text"] is None and got[n]["error"] for n in ("e.docx", "f.pdf", "g.exe", "h.mobi"))
    paged = read_files(spark, str(folder), "*.pdf", pdf=lambda b: "Run Head\none\fRun Head\ntwo\fRun Head\nthree").collect()
    assert [r["text"] for r in paged] == ["one\ntwo\nthree"]


def test_extract(spark, folder):
    docs = api.extract(spark, [str(folder)])
    rows = docs.where("error IS NULL").collect()
    assert len(rows) == 4 and all(len(r["content_hash"]) == 16 for r in rows)
    with pytest.raises(ValueError, match="no sources"):
        api.extract(spark, [])


def test_replay(spark, folder):
    lock = api.record(api.extract(spark, [str(folder)]), "n", [str(folder)])
    assert len(lock.documents) == 4 and lock.estimated_tokens > 0 and api.replay(spark, lock).count() == 0
    (folder / "a.txt").write_text("other")
    (folder / "new.md").write_text("new")
    (folder / "d.csv").unlink()
    assert sorted(r["change"] for r in api.replay(spark, lock).collect()) == ["added", "changed", "removed"]
    with pytest.raises(ValueError):
        api.record(api.extract(spark, [str(folder)]), "n", [], most=1)


def test_skills_on_disk(spark, tmp_path):
    for name, text in {"one/SKILL.md": "---\nname: one\ndescription: Use when the user wants the first of all things done.\n---\nsee references/x.md\n", "one/references/x.md": "x", "one/inner/SKILL.md": "hidden", "two/SKILL.md": "bare"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    skills, refs = read_skills(spark, str(tmp_path))
    assert {r["dir_name"] for r in skills.collect()} == {"one", "two"} and [r["path"] for r in refs.collect()] == ["references/x.md"]
    findings, tree, costs = api.audit(spark, str(tmp_path))
    assert {r["rule"] for r in findings.collect()} == {"no-frontmatter", "no-description"} and tree.count() == 0 and costs.count() == 2


def test_build_and_examine(spark):
    docs = spark.createDataFrame([("p", "# A\nsource: u\none two\n# B\nsource: v\nthree")], "path string, text string")
    chunks = api.plan(docs)
    assert [r["tokens"] for r in chunks.orderBy("part_no").collect()] == [5, 4]
    reply = api.build(chunks, "path").first()
    assert reply["error"] is None and reply["reply"].startswith("# A")
    questions = spark.createDataFrame([(1, 1, "q"), (2, 1, "q")], "skill_id bigint, ordinal int, question string")
    contexts = spark.createDataFrame([(1, "ctx", False)], "skill_id bigint, context string, over boolean")
    given = dict((r["skill_id"], r["given"]) for r in api.examine(questions, contexts).collect())
    assert given[1].startswith("ctx") and given[2] == "NOT COVERED (no context)"


def test_retries():
    waits, calls = [], []

    def fails(system, user):
        calls.append(1)
        raise model.ModelError("busy", 503 if len(calls) < 9 else 400)

    with pytest.raises(model.ModelError):
        model.with_retries(fails, wait=waits.append)("", "")
    assert len(calls) == 4 and waits == [2.0, 4.0, 8.0]
    calls.extend([1] * 9)
    waits.clear()
    with pytest.raises(model.ModelError):
        model.with_retries(fails, wait=waits.append)("", "")
    assert waits == []
    assert model.text_of({"content": [{"type": "text", "text": "a"}, {"type": "tool", "text": "b"}]}) == "a"
    for bad in ({"content": []}, {"stop_reason": "max_tokens", "content": [{"type": "text", "text": "a"}]}):
        with pytest.raises(model.ModelError):
            model.text_of(bad)


def test_server():
    def broken(arguments):
        raise RuntimeError("broken")

    out = io.StringIO()
    lines = ["", "not json", '{"jsonrpc":"2.0","method":"ping"}', '{"id":1,"method":"initialize"}', '{"id":2,"method":"nope"}', '{"id":3,"method":"tools/call","params":{"name":"nope"}}', '{"id":4,"method":"tools/call","params":{"name":"t"}}', '{"id":5,"method":"tools/list"}']
    server.serve(lines, out, {"t": ("a tool", broken)})
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5]
    assert got[1]["error"]["code"] == -32601 and got[2]["error"]["code"] == -32602 and got[3]["result"]["isError"] and got[4]["result"]["tools"][0]["name"] == "t"
    assert server.read_text("abcdef", {"offset": 2, "limit": 2}).startswith("cd") and server.number({"n": "x"}, "n", 7) == 7 and server.strings({"l": ["a", 1]}, "l") == ["a"]


def test_server_tools_cover_all_files(spark, tmp_path):
    texts = [f"text {i:04} \U0001f600 end" for i in range(1100)]
    (tmp_path / "d").mkdir()
    for i, t in enumerate(texts):
        (tmp_path / f"d/f{i:04}.txt").write_text(t)
    for i in range(3):
        (tmp_path / f"d/p{i}.pdf").write_bytes(b"%PDF-")
    for i in range(3):
        (tmp_path / f"s/k{i}").mkdir(parents=True)
        (tmp_path / f"s/k{i}/SKILL.md").write_text("bare")
    tools = {n: f for n, (_, f) in server.tools_of(spark).items()}
    assert tools["read_text"]({}) == "\n\n[0/0]"
    got = json.loads(tools["extract"]({"sources": [str(tmp_path / "d")], "limit": 2}))
    assert got["documents"] == 1100 and got["failures_total"] == 3 and len(got["failures"]) == 2 and got["failures_continue_at"] == 2
    whole = "\n\n".join(texts)
    for offset, limit in ((0, 50_000), (5, 30), (19, 3), (len(whole) - 30, 100), (len(whole) + 5, 9)):
        assert tools["read_text"]({"offset": offset, "limit": limit}) == server.read_text(whole, {"offset": offset, "limit": limit})
    every = json.loads(tools["audit"]({"path": str(tmp_path / "s")}))
    pages, at = [], 0
    while at is not None:
        page = json.loads(tools["audit"]({"path": str(tmp_path / "s"), "offset": at, "limit": 4}))
        assert page["findings_total"] == every["findings_total"] == len(every["findings"])
        pages, at = pages + page["findings"], page.get("findings_continue_at")
    assert pages == every["findings"] and len(pages) > 4


def test_refresh_stream(spark, tmp_path):
    schema = "key string, text string, fetched_at timestamp"

    def add(rows):
        spark.createDataFrame(rows, "key string, text string, t string").select("key", "text", F.to_timestamp("t").alias("fetched_at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        refresh_stream(stream, str(tmp_path / "snap"), str(tmp_path / "state"))

    add([("a", "one", "2024-01-01"), ("a", "one", "2024-01-01"), ("b", "two", "2024-01-01")])
    run()
    add([("b", "changed", "2024-01-02"), ("c", "new", "2024-01-02"), ("a", "old", "2023-12-31")])
    run()
    last = max(tmp_path.glob("snap/v=*"), key=lambda p: int(p.name[2:]))
    assert {r["key"] for r in spark.read.parquet(str(last)).collect()} == {"a", "b", "c"}
    moved = [r for p in tmp_path.glob("snap/changes/v=*") for r in spark.read.parquet(str(p)).collect()]
    assert sorted((r["key"], r["change"]) for r in moved) == [("b", "changed"), ("c", "added")]


def test_numbered(spark):
    rows = [(k, "hot" if k % 3 else f"g{k % 2}") for k in range(0, 40_000, 7)] + [(-5, "hot"), (-4000, "hot")]
    got = tables.numbered(spark.createDataFrame(rows, "k bigint, g string"), ["g"], "k", "n").collect()
    seen = {}
    for k, g in sorted(rows):
        seen[g] = seen.get(g, 0) + 1
        rows[rows.index((k, g))] = (k, g, seen[g])
    assert sorted((r["k"], r["g"], r["n"]) for r in got) == sorted(rows)


def test_sample_is_bounded(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = [r["k"] for r in tables.bounded_sample(df, "k", 100)]
    b = [r["k"] for r in tables.bounded_sample(df.repartition(7), "k", 100)]
    assert len(a) == 100 and a == b
    assert len(tables.bounded_sample(df.limit(10).union(df.limit(10)), "k", 100)) == 10


def test_command_line(spark, folder, tmp_path, capsys):
    from lectern import cli

    out = str(tmp_path / "out")
    assert cli.main(["extract", str(folder), "--out", out]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"documents": 4, "failures": 4}
    assert cli.main(["plan", out]) == 0 and cli.main(["formats"]) == 0 and cli.main(["check"]) == 0 and cli.main(["sources", "o/r", str(folder)]) == 0
    assert cli.main(["refresh", out, out]) == 0
    assert cli.main(["build", out, "--out", str(tmp_path / "skill")]) == 0 and (tmp_path / "skill/SKILL.md").read_text()
    (tmp_path / "s/one").mkdir(parents=True)
    (tmp_path / "s/one/SKILL.md").write_text("bare")
    assert cli.main(["audit", str(tmp_path / "s")]) == 1


def test_registry_is_whole():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 70


def _model_of_questions():
    def _model(system, user):
        """Asks two questions an excerpt (a third too many), answers from the text, grades by what was given."""
        import re

        if system.startswith("Write questions"):
            n = int(re.match(r"Questions wanted: (\d+)", user).group(1))
            word = user.split("\n\n", 1)[1].split()[0]
            return "Here: " + json.dumps([{"question": f"What is {word} {i}?", "answer": word, "section": f"part {word}"} for i in range(n)] + [{"question": "one too many", "answer": "", "section": ""}])
        if system.startswith("Answer"):
            context, question = user.rsplit("\n\nQuestion: ", 1)
            word = question.split()[2]
            return word if word in context else "NOT COVERED"
        return "\n".join(f"{n}: {'PASS' if given == expected else 'FAIL - not there'}" for n, expected, given in re.findall(r"(\d+)\. Question: .*\nExpected: (.*)\nGiven: (.*)", user))

    return _model


def test_evaluation(spark):
    skills_ = spark.createDataFrame([(1, "about harbours", "alpha body"), (2, "big", "word " * 70_000), (3, "no questions", "x")], "skill_id bigint, description string, body string")
    refs = spark.createDataFrame([(1, "references/a.md", "beta text")], "skill_id bigint, path string, text string")
    texts = spark.createDataFrame([(1, "alpha one\nbeta two\ngamma three\n"), (2, "delta\n"), (3, None)], "skill_id bigint, text string")
    graded, report = api.evaluate(skills_, refs, texts, 6, _model_of_questions())
    rows = {(r["skill_id"], r["ordinal"]): r for r in graded.collect()}
    assert {k[0] for k in rows} == {1, 2} and not any(r["question"] == "one too many" for r in rows.values())
    assert all("over 60000 tokens" in r["given"] and not r["passed"] for k, r in rows.items() if k[0] == 2)
    got = {r["skill_id"]: r for r in report.collect()}
    assert got[2]["pass_rate"] == 0.0 and got[2]["weak_sections"] == ["part delta"]
    assert all(r["passed"] == (r["expected"] in {"alpha", "beta"}) for k, r in rows.items() if k[0] == 1) and 0 < got[1]["pass_rate"] <= 1
    with pytest.raises(ValueError):
        api.ask(texts, 0, _model_of_questions())
