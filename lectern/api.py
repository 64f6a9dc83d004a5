"""The surface of the engine: extract, audit, plan, examine, refresh; each a DataFrame in and a DataFrame out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import fnv1a, sanitize, trim
from lectern.model import Completer, complete_rows, stub
from lectern.operators import chunking, evals, report, skills, snapshots, sources
from lectern.sources.locks import Lock, Options
from lectern.sources.readers import Reader, read_skills
from lectern.sources.resolve import resolve as read_sources
from lectern.sources.tables import stored


def resolve(spark: SparkSession, inputs: list[str], options: Options | None = None, glob: str | None = None, pdf: Reader | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, notes) of files, folders, pages, sites and repositories: one row per document with its facts, and what there is to say of a source."""
    docs, notes = read_sources(spark, inputs, options, glob, pdf)
    return report.doc_facts(docs, "path").withColumn("text", sanitize(F.col("text"))), notes


def extract(spark: SparkSession, inputs: list[str], glob: str | None = None, pdf: Reader | None = None, options: Options | None = None) -> DataFrame:
    """The documents of ``resolve``: source, kind, path, origin, local_path, method, text, pages_needing_ocr, error and facts.  What can't be read is a row with an error."""
    return resolve(spark, inputs, options, glob, pdf)[0]


def classify(spark: SparkSession, raw: list[str], existing: set[str] | None = None) -> DataFrame:
    """(raw, kind, url, branch, subdir, label, error) of source strings."""
    rows = spark.createDataFrame([(r, r.strip() in (existing or set())) for r in raw], "raw string, there boolean")
    return rows.select("raw", sources.classify(F.col("raw"), F.col("there")).alias("c")).select("raw", "c.*")


def audit(spark: SparkSession, path: str, budget: int = skills.BODY_BUDGET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, tree findings, costs) of the skills under a folder."""
    found, refs = read_skills(spark, path)
    return skills.audit(found, refs, budget), skills.tree_findings(found), skills.costs(found, refs)


def plan(docs: DataFrame, key: str = "path", text: str = "text", most: int = chunking.CHUNK_TOKENS) -> DataFrame:
    """The chunks a build would send to a model, with what each costs."""
    from lectern.functions.text import estimate_tokens

    return chunking.chunk_rows(docs, key, text, most).withColumn("tokens", estimate_tokens(F.col("text")))


def build(chunks: DataFrame, key: str, purpose: str = "working-guide", complete: Completer = stub) -> DataFrame:
    """(key, reply, error): notes on every chunk, put together in order per key, and one answer over them."""
    words = chunking.PURPOSES[purpose]
    rows = chunks.withColumn("_id", F.to_json(F.struct(key, "part_no")))
    notes = complete_rows(rows, "_id", "text", f"Take notes of at most {words} words on this passage.", complete)
    joined = rows.join(notes, "_id")
    line = F.concat(F.lit("# "), "title", F.coalesce(F.concat(F.lit("\nsource: "), "origin"), F.lit("")), F.lit("\n\n"), F.coalesce("reply", F.concat(F.lit("NOT COVERED ("), "error", F.lit(")"))))
    per = joined.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_no", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("notes"))
    return complete_rows(per, key, "notes", "Write the files of a skill from these notes.", complete)


def examine(questions: DataFrame, contexts: DataFrame, complete: Completer = stub) -> DataFrame:
    """(skill_id, ordinal, given): an answer to each question (skill_id, ordinal, question) from the skill's context; failures say that nothing is covered.

    A skill over ``SKILL_TOKENS`` is put to no model; its answers say so.
    """
    rows = questions.join(contexts, "skill_id", "left").withColumn("_id", F.to_json(F.struct("skill_id", "ordinal")))
    prompt = F.when(~F.col("over"), F.concat("context", F.lit("\n\nQuestion: "), "question"))
    answers = complete_rows(rows.withColumn("_p", prompt), "_id", "_p", "Answer only from the text.", complete)
    why = F.coalesce("error", F.when(F.col("over"), f"the skill is over {evals.SKILL_TOKENS} tokens"), F.lit("no context"))
    return rows.join(answers, "_id").select("skill_id", "ordinal", F.coalesce("reply", F.concat(F.lit("NOT COVERED ("), why, F.lit(")"))).alias("given"))


def ask(texts: DataFrame, wanted: int = 12, complete: Completer = stub) -> DataFrame:
    """(skill_id, ordinal, question, expected, section): at most ``wanted`` questions on the source of each skill (skill_id, text), from excerpts spread over all of it.

    Replies are JSON arrays of question, answer and section; what isn't gives no question.
    """
    sizes = evals.batches(wanted)
    if not sizes:
        raise ValueError("no questions wanted")
    parts = evals.excerpts(texts, "skill_id", len(sizes)).withColumn("n", F.element_at(F.array(*map(F.lit, sizes)), F.col("excerpt_no").cast("int")))
    parts = parts.withColumn("_id", F.to_json(F.struct("skill_id", "excerpt_no"))).withColumn("_p", F.concat(F.lit("Questions wanted: "), F.col("n").cast("string"), F.lit("\n\n"), "excerpt"))
    system = "Write questions that this text answers, as a JSON array of objects with question, answer and section."
    replies = parts.join(complete_rows(parts, "_id", "_p", system, complete), "_id")
    found = F.from_json(evals.json_array(F.col("reply")), "array<struct<question:string,answer:string,section:string>>")
    rows = replies.select("skill_id", "excerpt_no", "n", F.posexplode(found).alias("_i", "_q")).where((trim(F.coalesce("_q.question", F.lit(""))) != "") & (F.col("_i") < F.col("n")))
    ordinal = F.row_number().over(W.partitionBy("skill_id").orderBy("excerpt_no", "_i"))
    return rows.select("skill_id", ordinal.alias("ordinal"), "_q.question", F.col("_q.answer").alias("expected"), "_q.section")


def evaluate(skills_: DataFrame, refs: DataFrame, texts: DataFrame, wanted: int = 12, complete: Completer = stub) -> tuple[DataFrame, DataFrame]:
    """(graded, report): questions on the sources (skill_id, text), answered from the skills alone, graded against the source's answers.

    graded: skill_id, ordinal, question, expected, section, given, passed, reason.  report: questions, passed, pass_rate and weak sections of each
    skill.  Each model call is made once and its answer kept as a table.
    """
    questions = stored(ask(texts, wanted, complete))
    answered = stored(questions.join(examine(questions, evals.skill_context(skills_, refs), complete), ["skill_id", "ordinal"]))
    line = F.concat(F.col("ordinal").cast("string"), F.lit(". Question: "), "question", F.lit("\nExpected: "), F.coalesce("expected", F.lit("")), F.lit("\nGiven: "), "given")
    # at most ``wanted`` lines a skill
    sheets = answered.groupBy("skill_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("_p"))
    replies = complete_rows(sheets, "skill_id", "_p", "Grade each answer on a line of its own: number: PASS or FAIL - reason.", complete)
    grades = evals.grades(stored(sheets.select("skill_id", "n").join(replies, "skill_id")), "skill_id", "reply", "n")
    graded = answered.join(grades, ["skill_id", "ordinal"])
    return graded, evals.report(graded, "skill_id")


def refresh(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, change) between a snapshot and the facts of a new reading (key, content_hash)."""
    return snapshots.changes(before, after)


def replay(spark: SparkSession, lock: Lock) -> DataFrame:
    """(key, change) since a build: its sources read again, held against what is on record."""
    again = extract(spark, lock.source_inputs, options=lock.source_options).where("error IS NULL").select(F.col("path").alias("key"), "content_hash")
    return refresh(lock.snapshot(spark), again)


def record(docs: DataFrame, name: str, inputs: list[str], options: Options | None = None, most: int = 1_000_000) -> Lock:
    """The record of a build from what was extracted; a build reads a bounded number of documents, more than ``most`` raise ValueError."""
    rows = docs.where("error IS NULL").select("path", "content_hash", "characters", "estimated_tokens").orderBy("path").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} documents in one build")
    whole = "".join(r["content_hash"] for r in rows)
    return Lock(
        name=name, built_with="lectern", source_inputs=inputs, source_options=options or Options(), content_hash=f"{fnv1a(whole.encode()):016x}",
        characters=sum(r["characters"] for r in rows), estimated_tokens=sum(r["estimated_tokens"] for r in rows), documents=[{"path": r["path"], "content_hash": r["content_hash"]} for r in rows],
    )


def passes(results: DataFrame, least: float) -> DataFrame:
    """(passed): whether the share of passed questions reaches ``least``."""
    return results.agg((F.coalesce(F.avg(F.col("passed").cast("double")), F.lit(0.0)) >= least).alias("passed"))


__all__ = ["ask", "audit", "build", "classify", "evaluate", "examine", "extract", "passes", "plan", "record", "refresh", "replay", "resolve"]
