"""Syntax trees from elsewhere: a cache by content, an external parser, foreign JSON.

The order is cache, external parser, own reader; each step takes what the one
before left over, and what failed says so in its status.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.sources.vb6 import extract

SCHEMA = "file string, sha256 string, parser_version string, status string, document string, note string"
KEYS = ["file", "sha256", "parser_version"]


def keyed(sources: DataFrame, parser_version: str) -> DataFrame:
    return sources.select("file", "content", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), F.lit(parser_version).alias("parser_version"))


def cached(sources: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that the cache has for exactly these contents, and the sources that it lacks."""
    return cache.join(sources.select(*KEYS), KEYS, "left_semi"), sources.join(cache.select(*KEYS), KEYS, "left_anti")


def run_parser(sources: DataFrame, command: list[str], timeout: float = 120.0) -> DataFrame:
    """One document for each source by a command that reads the source and prints JSON; failures are rows with status FAILED."""

    def one(content) -> tuple[str, str | None, str | None]:
        try:
            done = subprocess.run(command, input=bytes(content) if not isinstance(content, str) else content.encode(), capture_output=True, timeout=timeout, check=False)
        except (OSError, subprocess.TimeoutExpired) as e:
            return "FAILED", None, f"{type(e).__name__}"
        if done.returncode or not done.stdout.strip():
            return "FAILED", None, f"exit code {done.returncode}"
        try:
            return "OK", json.dumps(json.loads(done.stdout)), None
        except ValueError:
            return "FAILED", None, "no JSON"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [one(c) for c in pdf["content"]]
            yield pdf[KEYS].assign(status=[g[0] for g in got], document=[g[1] for g in got], note=[g[2] for g in got])

    return sources.mapInPandas(run, SCHEMA)


def translate(documents: DataFrame) -> DataFrame:
    """Foreign JSON as component name, language and procedures: OK if all are there, PARTIAL if some are, else UNKNOWN."""
    d = "document"
    name = F.coalesce(*[F.get_json_object(d, p) for p in ("$.component.name", "$.component", "$.name", "$.module")])
    language = F.coalesce(F.get_json_object(d, "$.language"), F.get_json_object(d, "$.lang"))
    procedures = F.coalesce(*[F.from_json(F.get_json_object(d, p), "array<struct<name:string,kind:string>>") for p in ("$.procedures", "$.component.procedures", "$.functions")])
    there = name.isNotNull().cast("int") + procedures.isNotNull().cast("int")
    status = F.when(there == 2, "OK").when(there == 1, "PARTIAL").otherwise("UNKNOWN")
    return documents.select("file", status.alias("status"), name.alias("component"), language.alias("language"), procedures.alias("procedures"))


def acquire(sources: DataFrame, parser_version: str, cache: DataFrame | None = None, command: list[str] | None = None, timeout: float = 120.0) -> DataFrame:
    """(file, status, origin, note) and the document or none: from the cache, the external parser, or the own reader."""
    left = keyed(sources, parser_version)
    parts = []
    if cache is not None:
        hits, left = cached(left, cache)
        parts.append(hits.select(*KEYS, "status", F.lit("cache").alias("origin"), "document", "note"))
    if command:
        got = run_parser(left, command, timeout)
        parts.append(got.where("status = 'OK'").select(*KEYS, "status", F.lit("external").alias("origin"), "document", "note"))
        failed = got.where("status <> 'OK'").select("file", F.col("note").alias("why"))
        left = left.join(failed, "file")
    else:
        left = left.withColumn("why", F.lit(None).cast("string"))
    own = extract(left.select("file", "content"))
    docs = own.groupBy("file").agg(F.to_json(F.sort_array(F.collect_list(F.struct("seq", "entity", "payload")))).alias("document"), F.max_by(F.get_json_object("payload", "$.status"), F.col("entity") == "file").alias("read"))
    status = F.when(F.col("read") == "FAILED", "FAILED").when(F.col("why").isNotNull(), "PARTIAL").otherwise(F.col("read"))
    parts.append(left.join(docs, "file").select(*KEYS, status.alias("status"), F.lit("own").alias("origin"), "document", F.col("why").alias("note")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


OWN = "array<struct<seq:int,entity:string,payload:string>>"


def entities(documents: DataFrame) -> DataFrame:
    """(file, entity, seq, payload) of documents, as ``vb6.extract`` gives them.

    Documents of the own reader have all entities. Of foreign ones come the
    component and its procedures, as far as they are told; a document that is not
    there leaves a file that failed.
    """
    own = documents.where("document LIKE '[%'").select("file", F.explode(F.from_json("document", OWN)).alias("x")).select("file", "x.entity", "x.seq", "x.payload")
    rest = documents.where("document IS NULL OR document NOT LIKE '[%'")
    told = rest.select("file", "sha256", "note", "document").join(translate(rest.select("file", "document")), "file")
    notes = F.when(F.col("note").isNotNull(), F.array("note")).otherwise(F.array().cast("array<string>"))
    status = F.when(F.col("document").isNull(), "FAILED").otherwise(F.col("status"))
    rows = lambda df, entity, seq, payload: df.select("file", F.lit(entity).alias("entity"), seq.cast("int").alias("seq"), F.to_json(payload).alias("payload"))
    files = rows(told, "file", F.lit(0), F.struct("sha256", F.lit(0).alias("line_count"), status.alias("status"), notes.alias("diagnostics")))
    named = told.where("component IS NOT NULL")
    none = F.array().cast("array<string>")
    components = rows(named, "component", F.lit(1), F.struct(F.col("component").alias("name"), F.lit("UNKNOWN").alias("kind"), "status", none.alias("depends_on"), none.alias("attention_points")))
    each = named.select("file", "component", F.posexplode("procedures").alias("i", "p")).where("p.name IS NOT NULL")
    procedures = rows(each, "procedure", F.col("i") + 2, F.struct("component", F.col("p.name").alias("name"), F.coalesce("p.kind", F.lit("sub")).alias("kind"), F.lit("public").alias("visibility"), F.lit(False).alias("declared"), F.lit("").alias("body"), F.array().cast("array<struct<name:string>>").alias("parameters")))
    return own.unionByName(files).unionByName(components).unionByName(procedures)


def store(documents: DataFrame, path: str) -> None:
    """Adds documents to the cache; they are looked up by file, content and parser version."""
    documents.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.mode("append").parquet(path)


def artifacts(spark, folder: str) -> DataFrame:
    """Files below a folder by extension, and how many API operations their text declares."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ext = F.lower(F.regexp_extract("path", r"[.]([^./\\]+)$", 1))
    n = F.when(ext.isin("yaml", "yml"), F.regexp_count(F.col("content").cast("string"), F.lit(r"operationId:"))).otherwise(0)
    return files.select(ext.alias("extension"), n.alias("n")).groupBy("extension").agg(F.count("*").alias("files"), F.sum("n").alias("operations"))
