"""Skill packages: frontmatter, links, costs and the audit's rules, all as sets.

A skill is (skill_id, dir_name, path, name, description, license, extra, body); a
reference file is (skill_id, path, text).  Findings are (skill_id, rule,
severity, subject); severities rank error, warning, note.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.terms import ascii_lower, distinctive_terms
from lectern.functions.text import WS, estimate_tokens, lines, slashes, trim, unquote
from lectern.functions.words import TRIGGERS
from lectern.sources.tables import one_per_key

#: Limits of the audit.
MOST_CHARS, LEAST_CHARS, BODY_BUDGET = 1024, 40, 2000
OVERLAP, SHARED_TERMS, LEAST_TERMS = 0.34, 3, 3
RANK = {"error": 0, "warning": 1, "note": 2}


def frontmatter(raw: Column) -> Column:
    """struct(found, fields: array of (key, value), body) of a SKILL.md.

    The block stands between a first line --- and the next line --- that is followed by
    a line end; else all is body.  A line that begins with white space or a hyphen
    belongs to the line before it, joined by one space.  Keys are in lower case,
    in order, doubles included; one pair of quotes around a value is dropped.
    """
    text = F.regexp_replace(raw, r"^\x{FEFF}", "")
    # up to the first line that is --- but for white space behind it
    fence = r"(?s)^---\r?\n((?:.*?\n)??)---[\t\x{B}\f\r ]*\n(.*)$"
    found = text.rlike(fence)
    folded = F.regexp_replace(F.regexp_extract(text, fence, 1), f"\\r?\\n(?=[ \\t-])[{WS}]*([^\\n]*)", " $1")
    keyed = F.filter(lines(folded), lambda x: x.rlike(f"^[{WS}]*[^:{WS}][^:]*:|^[^:]*[^:{WS}][^:]*:"))
    fields = F.transform(
        keyed,
        lambda x: F.struct(ascii_lower(trim(F.regexp_extract(x, "^([^:]*):", 1))).alias("key"), unquote(trim(F.regexp_extract(x, "(?s)^[^:]*:(.*)$", 1))).alias("value")),
    )
    return F.struct(found.alias("found"), F.when(found, fields).alias("fields"), F.when(found, F.regexp_extract(text, fence, 2)).otherwise(text).alias("body"))


def field(fields: Column, key: str) -> Column:
    """The last value of a key; null where it isn't set."""
    return F.try_element_at(F.transform(F.filter(fields, lambda f: f["key"] == key), lambda f: f["value"]), F.lit(-1))


def effective_name(name: Column, directory: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), directory)


def linked_paths(body: Column) -> Column:
    """Distinct paths a body points at: Markdown targets, and bare mentions of references/."""
    targets = F.transform(
        F.regexp_extract_all(body, F.lit(r"\]\(([^)]*)\)"), F.lit(1)),
        lambda x: slashes(F.regexp_replace(F.try_element_at(F.split(trim(x), f"[{WS}]+"), F.lit(1)), r"^(?:\./)+", "")),
    )
    bare = F.transform(F.split(body, f"[{WS}`\"'()]"), lambda x: F.regexp_replace(slashes(F.regexp_replace(x, r"^(?:\./)+", "")), r"[,.;:]+$", ""))
    return F.array_distinct(F.concat(F.filter(targets, lambda x: x != ""), F.filter(bare, lambda x: x.startswith("references/") & ~x.endswith("/"))))


def mentions(raw: Column) -> Column:
    """The words of a text that may be file names."""
    return F.split(raw, r"[^\p{IsAlphabetic}\p{N}._-]+")


def costs(skills: DataFrame, refs: DataFrame) -> DataFrame:
    """(skill_id, name, always_loaded, on_trigger, on_demand, reference_files): what a skill costs in tokens, and when."""
    name = effective_name(F.col("name"), F.col("dir_name"))
    own = skills.select(
        "skill_id", name.alias("name"),
        estimate_tokens(F.concat(name, F.lit("\n"), F.coalesce("description", F.lit("")))).alias("always_loaded"),
        F.coalesce(estimate_tokens(F.col("body")), F.lit(0)).cast("bigint").alias("on_trigger"),
    )
    demand = refs.groupBy("skill_id").agg(F.sum(estimate_tokens(F.col("text"))).alias("on_demand"), F.count("*").alias("reference_files"))
    return own.join(demand, "skill_id", "left").fillna(0, ["on_demand", "reference_files"])


def heaviest(cost: DataFrame, budget: int = BODY_BUDGET) -> DataFrame:
    """(name, on_trigger) of the largest body over the budget; of equal ones the last."""
    over = cost.where(F.col("on_trigger") > budget)
    return over.agg(F.max_by("name", F.struct("on_trigger", "skill_id")).alias("name"), F.max("on_trigger").alias("on_trigger")).where("name is not null")


def _finding(rows: DataFrame, rule: str, severity: str | Column, subject: Column) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select("skill_id", F.lit(rule).alias("rule"), severity.alias("severity"), subject.cast("string").alias("subject"))


def no_frontmatter(skills: DataFrame) -> DataFrame:
    bare = F.col("name").isNull() & F.col("description").isNull() & F.col("license").isNull() & (F.coalesce(F.size("extra"), F.lit(0)) <= 0)
    return _finding(skills.where(bare), "no-frontmatter", "error", F.col("path"))


def _described(skills: DataFrame) -> DataFrame:
    return skills.where(F.coalesce("description", F.lit("")) != "").withColumn("_n", F.char_length("description"))


def no_description(skills: DataFrame) -> DataFrame:
    return _finding(skills.where(F.coalesce("description", F.lit("")) == ""), "no-description", "error", F.col("path"))


def description_too_long(skills: DataFrame) -> DataFrame:
    return _finding(_described(skills).where(F.col("_n") > MOST_CHARS), "description-too-long", "error", F.col("_n"))


def description_too_short(skills: DataFrame) -> DataFrame:
    return _finding(_described(skills).where(F.col("_n") < LEAST_CHARS), "description-too-short", "warning", F.col("_n"))


def description_not_routable(skills: DataFrame) -> DataFrame:
    said = ascii_lower(F.col("description")).rlike("|".join(TRIGGERS))
    return _finding(_described(skills).where(~said), "description-not-routable", "warning", F.col("_n"))


def name_mismatch(skills: DataFrame) -> DataFrame:
    return _finding(skills.where(F.col("name") != F.col("dir_name")), "name-mismatch", "warning", F.col("name"))


def name_not_kebab_case(skills: DataFrame) -> DataFrame:
    return _finding(skills.where((F.col("name") != "") & ~F.col("name").rlike(r"\A[a-z0-9-]+\z")), "name-not-kebab-case", "warning", F.col("name"))


def body_over_budget(cost: DataFrame, budget: int = BODY_BUDGET) -> DataFrame:
    severity = F.when(F.col("on_trigger") > 2 * budget, "error").otherwise("warning")
    return _finding(cost.where(F.col("on_trigger") > budget), "body-over-budget", severity, F.col("on_trigger"))


def links(skills: DataFrame) -> DataFrame:
    """(skill_id, link)"""
    return skills.select("skill_id", F.explode(linked_paths(F.col("body"))).alias("link"))


def broken_reference_link(skills: DataFrame, refs: DataFrame) -> DataFrame:
    inside = links(skills).where(F.col("link").startswith("references/") & ~F.col("link").endswith("/"))
    there = refs.select("skill_id", slashes(F.col("path")).alias("link"))
    return _finding(inside.join(there, ["skill_id", "link"], "left_anti"), "broken-reference-link", "error", F.col("link"))


def orphan_reference(skills: DataFrame, refs: DataFrame) -> DataFrame:
    there = refs.select("skill_id", slashes(F.col("path")).alias("link")).distinct().join(links(skills), ["skill_id", "link"], "left_anti")
    file = F.regexp_extract("link", r"([^/]*)$", 1)
    stem = F.regexp_replace(file, r"\.[^.]*$", "")
    named = there.withColumns({"_file": file, "_stem": stem}).join(skills.select("skill_id", F.concat_ws("\n", "name", "description", "body").alias("_raw")), "skill_id")
    words = mentions(F.col("_raw"))
    said = (F.col("_stem") != "") & (F.array_contains(words, F.col("_file")) | F.array_contains(words, F.col("_stem")))
    return _finding(named.where(~said), "orphan-reference", "note", F.col("link"))


def no_progressive_disclosure(cost: DataFrame, budget: int = BODY_BUDGET) -> DataFrame:
    return _finding(cost.where((F.col("on_trigger") > budget) & (F.col("reference_files") == 0)), "no-progressive-disclosure", "note", F.col("on_trigger"))


def empty_reference(refs: DataFrame) -> DataFrame:
    return _finding(refs.where(trim(F.coalesce("text", F.lit(""))) == ""), "empty-reference", "warning", F.col("path"))


def duplicate_name(skills: DataFrame) -> DataFrame:
    """(name, path): the skills of names that more than one skill goes by, one row each, however many share one."""
    named = skills.select(effective_name(F.col("name"), F.col("dir_name")).alias("name"), "path")
    twice = named.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
    return named.join(twice, "name", "left_semi")


def trigger_overlap(skills: DataFrame) -> DataFrame:
    """(skill_a, skill_b, shared): pairs whose terms overlap, by an equi-join on terms.

    The pair of sizes is checked before pairs are built, rarest terms come first,
    and a pair meets only at the terms of its prefixes: a pair with the overlap the
    sizes call for must share one of the first size - least + 1 terms of each.
    """
    sets = skills.select("skill_id", F.array_sort(distinctive_terms(F.col("description"))).alias("terms")).where(F.size("terms") >= LEAST_TERMS)
    rows = sets.select("skill_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    ranked = rows.join(df, "term").withColumn("pos", F.row_number().over(W.partitionBy("skill_id").orderBy("df", "term")))
    # against any partner at least ceil(t * n) terms are shared, and never fewer than three
    need = F.greatest(F.lit(SHARED_TERMS), F.ceil(F.lit(OVERLAP) * F.col("n")))
    prefix = ranked.where(F.col("pos") <= F.col("n") - need + 1).select("skill_id", "term", "n")
    a, b = prefix.alias("a"), prefix.alias("b")
    met = a.join(b, (F.col("a.term") == F.col("b.term")) & (F.col("a.skill_id") < F.col("b.skill_id")) & (F.col("a.n") >= F.lit(OVERLAP) * F.col("b.n")) & (F.col("b.n") >= F.lit(OVERLAP) * F.col("a.n")))
    pairs = met.select(F.col("a.skill_id").alias("skill_a"), F.col("b.skill_id").alias("skill_b")).distinct()
    full = pairs.join(sets.select(F.col("skill_id").alias("skill_a"), F.col("terms").alias("ta")), "skill_a").join(sets.select(F.col("skill_id").alias("skill_b"), F.col("terms").alias("tb")), "skill_b")
    shared = F.size(F.array_intersect("ta", "tb"))
    scored = full.select("skill_a", "skill_b", shared.alias("shared"), (F.size("ta") + F.size("tb") - shared).alias("either"))
    return scored.where((F.col("shared") >= SHARED_TERMS) & (F.col("shared") / F.col("either") >= OVERLAP)).select("skill_a", "skill_b", F.col("shared").cast("bigint").alias("shared"))


def audit(skills: DataFrame, refs: DataFrame, budget: int = BODY_BUDGET) -> DataFrame:
    """All findings of single skills, and an overlap for each of its two skills, as (skill_id, rule, severity, subject)."""
    skills = one_per_key(skills, "skill_id")
    cost = costs(skills, refs)
    overlap = trigger_overlap(skills)
    both = overlap.select(F.col("skill_a").alias("skill_id"), F.col("skill_b").alias("other")).unionByName(overlap.select(F.col("skill_b").alias("skill_id"), F.col("skill_a").alias("other")))
    parts = [
        no_frontmatter(skills), no_description(skills), description_too_long(skills), description_too_short(skills), description_not_routable(skills), name_mismatch(skills),
        name_not_kebab_case(skills), body_over_budget(cost, budget), broken_reference_link(skills, refs), orphan_reference(skills, refs), no_progressive_disclosure(cost, budget),
        empty_reference(refs), _finding(both, "trigger-overlap", "warning", F.col("other")),
    ]
    return reduce(DataFrame.unionByName, parts)


def tree_findings(skills: DataFrame) -> DataFrame:
    """Findings between skills: (rule, severity, subject)."""
    skills = one_per_key(skills, "skill_id")
    twice = duplicate_name(skills).select("name").distinct().select(F.lit("duplicate-name").alias("rule"), F.lit("error").alias("severity"), F.col("name").alias("subject"))
    overlap = trigger_overlap(skills).select(F.lit("trigger-overlap").alias("rule"), F.lit("warning").alias("severity"), F.concat_ws(",", "skill_a", "skill_b").alias("subject"))
    return twice.unionByName(overlap)


def totals(findings: DataFrame, tree: DataFrame) -> DataFrame:
    """(severity, findings), an overlap counting for the tree and for both of its skills."""
    every = findings.select("severity").unionByName(tree.select("severity"))
    return every.groupBy("severity").agg(F.count("*").alias("findings"))


def passes(total: DataFrame, strict: bool = False) -> DataFrame:
    """(passed): no errors, and in strict mode no warnings."""
    bad = F.col("severity").isin(*(["error", "warning"] if strict else ["error"]))
    return total.agg((F.coalesce(F.sum(F.when(bad, F.col("findings"))), F.lit(0)) == 0).alias("passed"))
