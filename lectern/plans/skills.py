"""Queries on skills and their audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.terms import distinctive_terms
from lectern.functions.words import STOP_WORDS, TRIGGERS
from lectern.operators import skills as S
from lectern.plans.base import Registry
from lectern.plans.texts import _BARE, _TOKENS
from lectern.sources.tables import one_per_key, table

R = Registry()

#: A budget that the bodies of the test tables exceed now and then.
BUDGET = 70

_S = "s AS (SELECT DISTINCT ON (skill_id) * FROM skills)"
_REFS = """r AS (SELECT skill_id, CASE WHEN i = 1 THEN coalesce(nullif(regexp_extract(s.body, '(references/[a-z-]+\\.md)', 1), ''), 'references/one.md') ELSE 'references/extra-' || i || '.md' END AS path,
  CASE WHEN (skill_id + i) % 5 = 0 THEN ' ' ELSE coalesce(s.description, '') END AS text
  FROM s JOIN (SELECT DISTINCT ON (skill_id) skill_id, reference_files FROM skill_reports) p USING (skill_id), (SELECT unnest(range(1, 100)) AS i) WHERE i <= p.reference_files)"""
_NAME = "coalesce(nullif(name, ''), dir_name)"
_COST = f"""c AS (SELECT skill_id, {_NAME} AS name, {_TOKENS.format("(" + _NAME + " || chr(10) || coalesce(description, ''))")} AS always_loaded, coalesce({_TOKENS.format('body')}, 0) AS on_trigger,
  coalesce(on_demand, 0) AS on_demand, coalesce(n, 0) AS reference_files FROM s LEFT JOIN (SELECT skill_id, CAST(sum({_TOKENS.format('text')}) AS BIGINT) AS on_demand, count(*) AS n FROM r GROUP BY skill_id) USING (skill_id))"""


def _skills(spark: SparkSession, d: str) -> DataFrame:
    return one_per_key(table(spark, d, "skills"), "skill_id")


def _refs(spark: SparkSession, d: str) -> DataFrame:
    """Reference files made from what the reports say of them: as many as they count, the first one linked, some of them blank."""
    p = one_per_key(table(spark, d, "skill_reports").select("skill_id", "reference_files"), "skill_id").where("reference_files > 0")
    rows = _skills(spark, d).select("skill_id", "description", "body").join(p, "skill_id").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("reference_files"))))
    linked = F.regexp_extract("body", r"(references/[a-z-]+\.md)", 1)
    path = F.when(F.col("i") == 1, F.coalesce(F.nullif(linked, F.lit("")), F.lit("references/one.md"))).otherwise(F.concat(F.lit("references/extra-"), F.col("i"), F.lit(".md")))
    text = F.when((F.col("skill_id") + F.col("i")) % 5 == 0, " ").otherwise(F.coalesce("description", F.lit("")))
    return rows.select("skill_id", path.alias("path"), text.alias("text"))


@R.add(
    rf"""WITH {_S} SELECT skill_id, name IS NOT NULL OR description IS NOT NULL AS found, name, CASE WHEN description IS NULL THEN NULL ELSE regexp_replace({_BARE.format('description')}, '\n[<WS>]*', ' ', 'g') END AS description,
    license, CAST(coalesce(len(extra), 0) AS BIGINT) AS others, md5(body) AS body FROM s WHERE description IS NULL OR (NOT regexp_matches(description, '\n[^ \t-]') AND NOT regexp_matches({_BARE.format('description')}, '^["''].*["'']$'))"""
)
def frontmatter(spark: SparkSession, d: str) -> DataFrame:
    """Skills written out as files and read again; descriptions that don't survive a file (a line of their own, quotes around them) aside."""
    s = _skills(spark, d)
    keep = F.col("description").isNull() | (~F.col("description").rlike(r"\n[^ \t-]") & ~S.trim(F.col("description")).rlike("^[\"'].*[\"']$"))
    parts = [F.concat(F.lit(f"{k}: "), F.col(k), F.lit("\n")) for k in ("name", "description", "license")]
    extra = F.array_join(F.transform("extra", lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\n"))), "")
    block = F.concat_ws("", *parts, extra)
    raw = F.when(F.col("name").isNull() & F.col("description").isNull(), F.col("body")).otherwise(F.concat(F.lit("---\n"), block, F.lit("---\n"), F.col("body")))
    read = s.where(keep).select("skill_id", S.frontmatter(raw).alias("f"))
    others = F.size(F.filter("f.fields", lambda x: ~x["key"].isin("name", "description", "license")))
    return read.select(
        "skill_id", F.col("f.found").alias("found"), S.field(F.col("f.fields"), "name").alias("name"), S.field(F.col("f.fields"), "description").alias("description"),
        S.field(F.col("f.fields"), "license").alias("license"), F.greatest(F.coalesce(others, F.lit(0)), F.lit(0)).cast("bigint").alias("others"), F.md5("f.body").alias("body"),
    )


_WORDS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_T = f"""t AS (SELECT DISTINCT skill_id, translate(trim(w, '-'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT skill_id, unnest(regexp_split_to_array(description, '[^\\p{{L}}\\p{{M}}\\p{{N}}-]+')) AS w FROM s)
  WHERE octet_length(encode(trim(w, '-'))) >= 4 AND translate(trim(w, '-'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') NOT IN ({_WORDS}))"""
_OVERLAP = f"""n AS (SELECT skill_id, count(*) AS n FROM t GROUP BY skill_id HAVING count(*) >= 3),
  o AS (SELECT a.skill_id AS skill_a, b.skill_id AS skill_b, count(*) AS shared FROM t a JOIN t b ON a.term = b.term AND a.skill_id < b.skill_id GROUP BY 1, 2),
  v AS (SELECT skill_a, skill_b, shared FROM o JOIN n x ON x.skill_id = skill_a JOIN n y ON y.skill_id = skill_b WHERE shared >= 3 AND shared::DOUBLE / (x.n + y.n - shared) >= 0.34)"""


@R.add(f"WITH {_S}, {_T} SELECT skill_id, term FROM t")
def distinctive_term_rows(spark: SparkSession, d: str) -> DataFrame:
    return _skills(spark, d).select("skill_id", F.explode(distinctive_terms(F.col("description"))).alias("term"))


@R.add(
    rf"""WITH {_S}, a AS (SELECT skill_id, unnest(regexp_split_to_array(body, '[<WS>`"''()]')) AS w FROM s),
    b AS (SELECT skill_id, regexp_replace(replace(regexp_replace(w, '^(?:\./)+', ''), chr(92), '/'), '[,.;:]+$', '') AS link FROM a)
    SELECT DISTINCT skill_id, link FROM b WHERE link LIKE 'references/%' AND link NOT LIKE '%/'
    UNION SELECT DISTINCT skill_id, replace(regexp_replace(regexp_extract({_BARE.format('x')}, '^([^<WS>]*)', 1), '^(?:\./)+', ''), chr(92), '/') AS link
    FROM (SELECT skill_id, unnest(regexp_extract_all(body, '\]\(([^)]*)\)', 1)) AS x FROM s) WHERE link <> ''"""
)
def skill_links(spark: SparkSession, d: str) -> DataFrame:
    return S.links(_skills(spark, d))


@R.add(f"WITH {_S}, {_REFS}, {_COST} SELECT * FROM c")
def skill_costs(spark: SparkSession, d: str) -> DataFrame:
    return S.costs(_skills(spark, d), _refs(spark, d))


@R.add(f"WITH {_S}, {_REFS}, {_COST} SELECT name, on_trigger FROM c WHERE on_trigger > {BUDGET} ORDER BY on_trigger DESC, skill_id DESC LIMIT 1")
def heaviest_body(spark: SparkSession, d: str) -> DataFrame:
    return S.heaviest(S.costs(_skills(spark, d), _refs(spark, d)), BUDGET)


def _f(rule: str, severity: str, subject: str, rest: str) -> str:
    return f"SELECT skill_id, '{rule}' AS rule, {severity} AS severity, {subject} AS subject FROM {rest}"


_SAID = " OR ".join(f"contains(translate(description, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{t}')" for t in TRIGGERS)
_LINKS = rf"""l AS (SELECT DISTINCT skill_id, regexp_replace(w, '[,.;:]+$', '') AS link FROM (SELECT skill_id, unnest(regexp_split_to_array(body, '[<WS>`"''()]')) AS w FROM s) WHERE w LIKE 'references/%')"""
_FILE = "regexp_extract(r.path, '([^/]*)$', 1)"
_RULES = {
    "r01_no_frontmatter": _f("no-frontmatter", "'error'", "path", "s WHERE name IS NULL AND description IS NULL AND license IS NULL AND coalesce(len(extra), 0) = 0"),
    "r02_no_description": _f("no-description", "'error'", "path", "s WHERE coalesce(description, '') = ''"),
    "r03_description_too_long": _f("description-too-long", "'error'", "CAST(length(description) AS VARCHAR)", "s WHERE length(description) > 1024"),
    "r04_description_too_short": _f("description-too-short", "'warning'", "CAST(length(description) AS VARCHAR)", "s WHERE length(description) BETWEEN 1 AND 39"),
    "r05_description_not_routable": _f("description-not-routable", "'warning'", "CAST(length(description) AS VARCHAR)", f"s WHERE description <> '' AND NOT ({_SAID})"),
    "r06_name_mismatch": _f("name-mismatch", "'warning'", "name", "s WHERE name <> dir_name"),
    "r07_name_not_kebab_case": _f("name-not-kebab-case", "'warning'", "name", "s WHERE name <> '' AND NOT regexp_full_match(name, '[a-z0-9-]+')"),
    "r08_body_over_budget": _f("body-over-budget", f"CASE WHEN on_trigger > {2 * BUDGET} THEN 'error' ELSE 'warning' END", "CAST(on_trigger AS VARCHAR)", f"c WHERE on_trigger > {BUDGET}"),
    "r09_broken_reference_link": _f("broken-reference-link", "'error'", "link", "l WHERE link NOT LIKE '%/' AND NOT EXISTS (SELECT 1 FROM r WHERE r.skill_id = l.skill_id AND r.path = l.link)"),
    "r10_orphan_reference": "SELECT DISTINCT r.skill_id, 'orphan-reference' AS rule, 'note' AS severity, r.path AS subject FROM r JOIN s USING (skill_id) WHERE NOT EXISTS (SELECT 1 FROM l WHERE r.skill_id = l.skill_id AND r.path = l.link) "
    f"AND NOT list_has_any(regexp_split_to_array(concat_ws(chr(10), name, description, body), '[^\\p{{L}}\\p{{M}}\\p{{N}}._-]+'), [{_FILE}, regexp_replace({_FILE}, '\\.[^.]*$', '')])",
    "r11_no_progressive_disclosure": _f("no-progressive-disclosure", "'note'", "CAST(on_trigger AS VARCHAR)", f"c WHERE on_trigger > {BUDGET} AND reference_files = 0"),
    "r12_empty_reference": _f("empty-reference", "'warning'", "path", f"r WHERE {_BARE.format('text')} = ''"),
}
_WITH = f"WITH {_S}, {_REFS}, {_COST}, {_LINKS}"


def _rule(name: str, make) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        skills, refs = _skills(spark, d), _refs(spark, d)
        return make(skills, refs)

    query.__name__ = f"rule_{name}"
    R.add(f"{_WITH} {_RULES[name]}")(query)


_rule("r01_no_frontmatter", lambda s, r: S.no_frontmatter(s))
_rule("r02_no_description", lambda s, r: S.no_description(s))
_rule("r03_description_too_long", lambda s, r: S.description_too_long(s))
_rule("r04_description_too_short", lambda s, r: S.description_too_short(s))
_rule("r05_description_not_routable", lambda s, r: S.description_not_routable(s))
_rule("r06_name_mismatch", lambda s, r: S.name_mismatch(s))
_rule("r07_name_not_kebab_case", lambda s, r: S.name_not_kebab_case(s))
_rule("r08_body_over_budget", lambda s, r: S.body_over_budget(S.costs(s, r), BUDGET))
_rule("r09_broken_reference_link", S.broken_reference_link)
_rule("r10_orphan_reference", S.orphan_reference)
_rule("r11_no_progressive_disclosure", lambda s, r: S.no_progressive_disclosure(S.costs(s, r), BUDGET))
_rule("r12_empty_reference", lambda s, r: S.empty_reference(r))


_TWICE = f"d AS (SELECT {_NAME} AS name FROM s GROUP BY 1 HAVING count(*) > 1)"


@R.add(f"WITH {_S}, {_TWICE} SELECT d.name, path FROM d JOIN s ON {_NAME.replace('name,', 's.name,')} = d.name")
def rule_r13_duplicate_name(spark: SparkSession, d: str) -> DataFrame:
    return S.duplicate_name(_skills(spark, d))


@R.add(f"WITH {_S}, {_T}, {_OVERLAP} SELECT skill_a, skill_b, shared FROM v")
def rule_r14_trigger_overlap(spark: SparkSession, d: str) -> DataFrame:
    return S.trigger_overlap(_skills(spark, d))


_ALL = " UNION ALL ".join(f"({q})" for q in _RULES.values())


@R.add(
    f"""{_WITH}, {_T}, {_OVERLAP}, {_TWICE}, f AS ({_ALL})
    SELECT severity, count(*) AS findings FROM (SELECT severity FROM f UNION ALL SELECT 'error' FROM d UNION ALL SELECT 'warning' FROM v, (SELECT unnest([1, 2, 3]))) GROUP BY severity"""
)
def audit_totals(spark: SparkSession, d: str) -> DataFrame:
    skills = table(spark, d, "skills")
    return S.totals(S.audit(skills, _refs(spark, d), BUDGET), S.tree_findings(skills))
