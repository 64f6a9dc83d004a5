"""Command line: lectern extract | audit | plan | build | sources | formats | check | refresh | serve | query."""

from __future__ import annotations

import argparse
import json
import os
import sys


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("lectern").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lectern")
    sub = p.add_subparsers(dest="command", required=True)
    extract = sub.add_parser("extract", help="read files into a table of texts and facts")
    extract.add_argument("source", nargs="+")
    extract.add_argument("--glob")
    extract.add_argument("--crawl", action="store_true", help="walk sites instead of reading single pages")
    extract.add_argument("--max-pages", type=int, default=50)
    extract.add_argument("--depth", type=int, default=3)
    extract.add_argument("--delay-ms", type=int, default=250)
    extract.add_argument("--no-llms-txt", action="store_true")
    extract.add_argument("--branch")
    extract.add_argument("--max-files", type=int, default=200)
    extract.add_argument("--include", action="append", default=[])
    extract.add_argument("--exclude", action="append", default=[])
    extract.add_argument("--out", required=True, help="folder for the table")
    audit = sub.add_parser("audit", help="findings on skills; exit 1 on errors")
    audit.add_argument("path")
    audit.add_argument("--budget", type=int, default=2000)
    audit.add_argument("--strict", action="store_true", help="warnings fail too")
    plan = sub.add_parser("plan", help="the chunks of a build and their tokens")
    plan.add_argument("table", help="a table written by extract")
    plan.add_argument("--most", type=int, default=20_000)
    build = sub.add_parser("build", help="write a skill from a table written by extract; without a model of your own, the stub answers")
    build.add_argument("table")
    build.add_argument("--out", required=True, help="folder of the skill")
    build.add_argument("--purpose", default="working-guide", choices=["reference", "working-guide", "deep-study"])
    sub.add_parser("check", help="programs that add to what can be read")
    names = sub.add_parser("sources", help="what source strings name")
    names.add_argument("source", nargs="+")
    sub.add_parser("formats", help="extensions that can be read")
    refresh = sub.add_parser("refresh", help="what moved between two tables written by extract; exit 1 if anything did")
    refresh.add_argument("before")
    refresh.add_argument("after")
    sub.add_parser("serve", help="answer requests on standard input")
    query = sub.add_parser("query", help="run a named query over a folder of tables")
    query.add_argument("name")
    query.add_argument("folder")
    query.add_argument("--out", required=True)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "formats":
        from lectern.operators.sources import formats

        print("\n".join(formats()))
        return 0
    if a.command == "check":
        from lectern.sources.remote import tools

        for name, path in tools():
            print(f"{name}: {path or 'not found'}")
        return 0
    from lectern import api

    spark = session()
    from pyspark.sql.functions import concat_ws, format_string, lit

    if a.command == "extract":
        from lectern.sources.locks import Options

        options = Options(a.crawl, a.max_pages, a.depth, a.delay_ms, a.no_llms_txt, a.branch, a.max_files, a.include, a.exclude)
        docs, notes = api.resolve(spark, a.source, options, a.glob)
        for r in notes.collect():
            print(f"{r['source']}: {r['note']}", file=sys.stderr)
        docs.write.mode("overwrite").parquet(a.out)
        done = spark.read.parquet(a.out)
        failed = done.where("error IS NOT NULL").count()
        print(json.dumps({"documents": done.count() - failed, "failures": failed}))
        return int(done.where("text IS NOT NULL").isEmpty())
    if a.command == "audit":
        from lectern.operators.skills import passes, totals

        findings, tree, _ = api.audit(spark, a.path, a.budget)
        findings.orderBy("severity", "skill_id", "rule").show(200, truncate=False)
        tree.show(200, truncate=False)
        return int(not passes(totals(findings, tree), a.strict).first()[0])
    if a.command == "plan":
        api.plan(spark.read.parquet(a.table).where("text IS NOT NULL"), most=a.most).drop("text").show(200, truncate=80)
        return 0
    if a.command == "build":
        from lectern.operators.chunking import files_of
        from lectern.sources.locks import write_files

        docs = spark.read.parquet(a.table).where("text IS NOT NULL")
        # one skill from all of the table: notes are bounded by the purpose, chunks by what a model takes
        chunks = api.plan(docs).withColumn("skill", lit("skill"))
        answer = api.build(chunks.withColumnRenamed("part_no", "_part").withColumn("part_no", concat_ws("/", "path", format_string("%06d", "_part"))), "skill", a.purpose).first()
        files, error = files_of((answer["reply"] if answer else "") or "")
        write_files(a.out, files if error is None else [("SKILL.md", (answer["reply"] if answer else "") or "")])
        print("\n".join(p for p, _ in files) if error is None else "SKILL.md")
        return 0
    if a.command == "sources":
        here = {s.strip() for s in a.source if os.path.exists(os.path.expanduser(s.strip()))}
        api.classify(spark, a.source, here).show(200, truncate=False)
        return 0
    if a.command == "refresh":
        key = "path AS key"
        moved = api.refresh(*(spark.read.parquet(t).selectExpr(key, "content_hash") for t in (a.before, a.after)))
        moved.orderBy("change", "key").show(200, truncate=False)
        return int(not moved.isEmpty())
    if a.command == "query":
        from lectern.plans import registry

        registry.queries()[a.name](spark, a.folder).write.mode("overwrite").parquet(a.out)
        return 0
    from lectern.server import serve, tools_of

    serve(sys.stdin, sys.stdout, tools_of(spark))
    return 0


if __name__ == "__main__":
    sys.exit(main())
