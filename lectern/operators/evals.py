"""Examining what a skill kept of its source: excerpts, replies, grades, results."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import WS, lines, trim
from lectern.operators.chunking import counts, lines_of, tokens
from lectern.sources.tables import in_batches

#: Tokens per excerpt, and of a skill in front of a model.
EXCERPT_TOKENS, SKILL_TOKENS = 12_000, 60_000
SILENT = "no grade given"


def excerpts_of(text: str, count: int, most: int = EXCERPT_TOKENS) -> list[str]:
    """Excerpts spread over the whole text: its lines in ``count`` strides, each cut off once it is over the limit."""
    rows = lines_of(text) if text else []
    stride = -(-len(rows) // max(count, 1)) or 1
    out = []
    for start in range(0, len(rows), stride):
        # the estimate grows by whole lines, so it is kept as a sum of words and wide characters
        taken, words, wide = [], 0, 0
        for line in rows[start : start + stride]:
            if tokens(words, wide) > most:
                break
            taken.append(line)
            w, c = counts(line)
            words, wide = words + w, wide + c
        excerpt = "".join(x + "\n" for x in taken)
        if excerpt.strip():
            out.append(excerpt)
    return out


def excerpts(df: DataFrame, key: str, count: int, text: str = "text", most: int = EXCERPT_TOKENS) -> DataFrame:
    """(key, excerpt_no, excerpt)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [excerpts_of(x or "", count, most) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.string()))], names=[key, "parts"])

    rows = in_batches(df.select(key, text), run, f"`{key}` {df.schema[key].dataType.simpleString()}, parts array<string>")
    return rows.select(key, F.posexplode("parts").alias("_n", "excerpt")).select(key, (F.col("_n") + 1).cast("bigint").alias("excerpt_no"), "excerpt")


def json_array(reply: Column) -> Column:
    """From the first [ to the last ]; null where there is none."""
    found = F.regexp_extract(reply, r"(?s)\[.*\]", 0)
    return F.when(found != "", found)


def grades(replies: DataFrame, key: str, reply: str, count: str) -> DataFrame:
    """(key, ordinal, passed, reason) for 1 to count: what a line `n: PASS — why` says, the last one if several; silence fails."""
    asked = replies.select(key, F.explode(F.when(F.col(count) > 0, F.sequence(F.lit(1), F.col(count).cast("int"))).otherwise(F.array().cast("array<int>"))).alias("ordinal"))
    said = replies.select(key, F.col(count).alias("_c"), F.posexplode(lines(F.coalesce(reply, F.lit("")))).alias("_i", "_line")).withColumn("_line", trim(F.col("_line")))
    form = rf"^#*[{WS}]*([0-9]{{1,9}})[{WS}]*:[{WS}]*(?i)(pass|fail)(?-i)(?s)(.*)$"
    rest = F.regexp_extract("_line", form, 3)
    why = F.when(rest.rlike("[—-]"), trim(F.regexp_extract(rest, r"(?s)^[^—-]*[—-](.*)$", 1))).otherwise("")
    parsed = said.where(F.col("_line").rlike(form)).select(
        key, F.regexp_extract("_line", form, 1).cast("int").alias("ordinal"), F.struct("_i", (F.lower(F.regexp_extract("_line", form, 2)) == "pass").alias("p"), why.alias("w")).alias("_v")
    )
    last = parsed.groupBy(key, "ordinal").agg(F.max("_v").alias("_v"))
    return asked.join(last, [key, "ordinal"], "left").select(key, "ordinal", F.coalesce("_v.p", F.lit(False)).alias("passed"), F.coalesce("_v.w", F.lit(SILENT)).alias("reason"))


def report(graded: DataFrame, group: str, section: str = "section") -> DataFrame:
    """(group, questions, passed, pass_rate, weak_sections): weak sections are the distinct ones of failed questions, in order."""
    weak = F.array_sort(F.collect_set(F.when(~F.col("passed") & (trim(F.coalesce(section, F.lit(""))) != ""), F.col(section))))
    rows = graded.groupBy(group).agg(F.count("*").alias("questions"), F.count_if("passed").alias("passed"), weak.alias("weak_sections"))
    return rows.withColumn("pass_rate", F.coalesce(F.try_divide(F.col("passed").cast("double"), F.col("questions").cast("double")), F.lit(0.0)))


def batches(wanted: int) -> list[int]:
    """How many questions to ask for at a time: about three per batch."""
    n = -(-wanted // 3)
    per = -(-wanted // n) if n else 0
    return [min(per, wanted - i * per) for i in range(n) if wanted > i * per]


def skill_context(skills: DataFrame, refs: DataFrame) -> DataFrame:
    """(skill_id, context, over): a skill with all its references as one text; over where a model isn't to be given that much."""
    from lectern.functions.text import estimate_tokens

    demand = refs.groupBy("skill_id").agg(F.array_sort(F.collect_list(F.struct("path", "text"))).alias("_r"))
    joined = skills.join(demand, "skill_id", "left")
    tail = F.array_join(F.transform(F.coalesce("_r", F.array().cast("array<struct<path:string,text:string>>")), lambda r: F.concat(F.lit("\n\n# "), r["path"], F.lit("\n\n"), r["text"])), "")
    context = F.concat(F.lit("# SKILL.md\n\n"), F.coalesce("description", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit("")), tail)
    return joined.select("skill_id", context.alias("context")).withColumn("over", estimate_tokens(F.col("context")) > SKILL_TOKENS)


def api_error_message(body: Column) -> Column:
    """What a failed call says of itself: the message in its JSON, else its first 300 characters, else that it said nothing."""
    message = F.get_json_object(body, "$.error.message")
    return F.coalesce(F.nullif(message, F.lit("")), F.nullif(F.left(trim(body), F.lit(300)), F.lit("")), F.lit("no message"))


