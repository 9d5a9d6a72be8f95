"""Contexts for an extractor that reads text, and what comes back from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.text import redact

CANDIDATE = "array<struct<name:string,description:string,condition:struct<type:string,expression:string,fields:array<string>>,behavior:struct<type:string,reason:string,target:string>,observation:array<string>,inference:array<string>>>"


def render(template: str, **values: Column) -> Column:
    """A template with {name} replaced, no other syntax."""
    out = F.lit(template)
    for name, value in sorted(values.items()):
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def context(fragments: DataFrame, guidance: str = "") -> DataFrame:
    """One row: redacted fragments in order and guidance, as JSON, with its token estimate."""
    one = fragments.select(F.struct("fragment", "procedure", redact("text").alias("text")).alias("x")).agg(F.sort_array(F.collect_list("x")).alias("source_fragments"))
    made = one.select(F.to_json(F.struct(F.lit(guidance).alias("guidance"), "source_fragments")).alias("context"))
    return made.withColumn("tokens", F.greatest(F.lit(1), F.expr("length(context) DIV 4")))


def recover_array(answer: Column) -> Column:
    """The JSON array in an answer, out of a fence or of prose around it; null if there is none."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(\[.*?\])\s*```", 1)
    bare = F.regexp_extract(answer, r"(?s)(\[.*\])", 1)
    return F.nullif(F.when(fenced != "", fenced).otherwise(bare), F.lit(""))


def candidates(answers: DataFrame, column: str = "answer") -> tuple[DataFrame, DataFrame]:
    """Candidates with a name, a row each, and the answers or candidates that were dropped, with the reason."""
    parsed = answers.withColumn("c", F.from_json(recover_array(F.col(column)), CANDIDATE))
    rows = parsed.where("c IS NOT NULL").select(*answers.columns, F.posexplode("c").alias("seq", "x"))
    named = F.trim(F.coalesce("x.name", F.lit(""))) != ""
    good = rows.where(named).select("seq", "x.*")
    bad = parsed.where("c IS NULL").select(F.lit(None).cast("int").alias("seq"), F.lit("no JSON array").alias("reason")).unionAll(rows.where(~named).select("seq", F.lit("no name")))
    return good, bad
