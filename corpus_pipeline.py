"""The corpus pipeline: stages that each apply one operator to all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
have the columns of documents. Clean documents pass every filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import decontaminate, langid, mixing, pii, simhash
from quarrylens.llm.common import cut
from quarrylens.operators.lineage import drop, scratch


def apart(docs: DataFrame) -> tuple[DataFrame, str]:
    """The same rows under names that no operator uses, and the name of the text."""
    return docs.toDF(*[f"c{i}_" for i in range(len(docs.columns))]), f"c{docs.columns.index('text')}_"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with that language as their lang; texts that are null, have no letter or are foreign go."""
    model = langid.train(docs.select("text", "lang"))
    rows, text = apart(docs)
    told = langid.identify(rows, model, *rows.columns, text=text).where("lang_pred <> 'und' AND NOT foreign")
    if "lang" in docs.columns:
        told = told.withColumn(f"c{docs.columns.index('lang')}_", F.col("lang_pred").cast(dict(docs.dtypes)["lang"]))
    return told.select(*rows.columns).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingles, similarity of 0.8 and more."""
    return simhash.keep_one(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = cut(decontaminate.leaks(docs, items).select(F.col("doc_id").alias("leak_id"), F.col("tie").alias("leak_tie")).distinct())
    rows, text = apart(docs)
    key = F.col(f"c{docs.columns.index('doc_id')}_").cast("long").eqNullSafe(F.col("leak_id")) & (F.xxhash64(text) == F.col("leak_tie"))
    return rows.join(found, key, "left_anti").toDF(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    rows, text = apart(docs)
    found = pii.detect(rows, pii.train(docs), *rows.columns, text=text, redact=True)
    new = {text: F.col("redacted")}
    if "n_chars" in docs.columns:
        new[f"c{docs.columns.index('n_chars')}_"] = F.length("redacted").cast(dict(docs.dtypes)["n_chars"])
    return found.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns]).toDF(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each once, with its words and the number of copies that it takes; a name that is taken gets a "_" in front."""
    rows, text = apart(docs)
    at = lambda c: F.col(f"c{docs.columns.index(c)}_")
    named = rows.withColumns({"doc_id": at("doc_id"), "text": F.col(text), "source": at("source")})
    mixed = mixing.mix(named, *rows.columns).where("copies > 0")
    names = list(docs.columns)
    for c in ("n_words", "source_words", "target_words", "copies", "taken_words"):
        while c in names:
            c = f"_{c}"
        names.append(c)
    return mixed.toDF(*names)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("contamination", contamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: Language scores, fingerprints and balanced random samples cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again; what a stage no longer needs is deleted there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with scratch(spark) as kept:
            new = cut(stage(spark, docs, sf_dir))
            kept.append(new)
        drop(docs)
        docs = new
    return docs
