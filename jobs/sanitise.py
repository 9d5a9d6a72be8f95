"""Incremental job: source texts without their secrets, ready for prompts and reports.

Legacy sources arrive over time. Each run takes the files that are new in the
tables' folders (file streams with availableNow, one checkpoint for each feed),
redacts secrets, estimates tokens before and after, and writes the texts

    OUT/texts/feed=F/batch_id=N/part=P/*.parquet

A batch overwrites its own partitions and no others, so a run that broke off
between writing and its commit is repeated with the same result, and a run that
finds nothing new changes nothing. A path in braces may be a folder or one file. ``current`` gives each text once, however
often it was delivered.

    python -m jobs.sanitise --tables hdfs://…/tables --out hdfs://…/sanitised [--config FILE]
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions import text as tx
from quarrylens.operators.graph import keep_first
from quarrylens.streaming import runlog

log = logging.getLogger("jobs.sanitise")

CONFIG = Path(__file__).with_suffix(".json")
SCHEMA = "key bigint, digest string, text string, n_redacted bigint, tokens_before bigint, tokens_after bigint, feed string, batch_id bigint, part string"


def load_config(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text())


def sanitise(rows: DataFrame, part: str | None) -> DataFrame:
    """The columns of SCHEMA but for feed and batch_id, of rows (key, text, and ``part`` if it is named).

    A null text stays null, with a null digest and no tokens. Repeated rows stay.
    """
    tokens = lambda c: F.coalesce(tx.token_estimate(c), F.lit(0)).cast("long")
    marks = lambda c: F.coalesce(F.regexp_count(c, F.lit(r"\[REDACTED\]")), F.lit(0))
    where: Column = F.coalesce(tx.slug(part), F.lit("UNNAMED")) if part else F.lit("ALL")
    safe = rows.select(F.col("key").cast("long"), F.col("text").alias("raw"), tx.redact("text").alias("text"), where.alias("part"))
    return safe.select(
        "key",
        F.sha2("raw", 256).alias("digest"),
        "text",
        (marks("text") - marks("raw")).cast("long").alias("n_redacted"),
        tokens("raw").alias("tokens_before"),
        tokens("text").alias("tokens_after"),
        "part",
    )


def _feed(spark: SparkSession, name: str, feed: dict, tables: str, out: str, most_files: int | None) -> dict:
    """Takes what is new of one feed; returns the numbers of batches, rows read and rows written."""
    done = {"feed": name, "batches": 0, "read": 0, "written": 0}

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = sanitise(batch, feed.get("part")).withColumns({"feed": F.lit(name), "batch_id": F.lit(batch_id)})
        wrote = Observation()
        rows = rows.observe(wrote, F.count(F.lit(1)).alias("n"))
        # files of good size for each part, also where one part holds most of the rows
        rows.hint("rebalance", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feed", "batch_id", "part").parquet(f"{out}/texts")
        done["batches"] += 1
        done["written"] += wrote.get["n"]
        log.info("%s: batch %d wrote %d texts to %s/texts", name, batch_id, wrote.get["n"], out)

    columns = [F.col(feed["key"]).alias("key"), F.col(feed["text"]).alias("text"), *([F.col(feed["part"])] if feed.get("part") else [])]
    stream = spark.readStream.schema(feed["schema"])
    if most_files:
        stream = stream.option("maxFilesPerTrigger", most_files)
    source = stream.parquet(f"{tables}/{feed['path']}").select(*columns)
    query = source.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    done["read"] = sum(p["numInputRows"] for p in query.recentProgress)
    log.info("%s: read %d rows of %s/%s in %d batches", name, done["read"], tables, feed["path"], done["batches"])
    return done


def run(spark: SparkSession, tables: str, out: str, config: dict | None = None) -> list[dict]:
    """One run over all feeds; returns for each feed what was read and written."""
    config = config or load_config()
    told = []
    for name, feed in config["feeds"].items():
        with runlog.timed(spark, f"{out}/log", "sanitise", source=name) as details:
            told.append(_feed(spark, name, feed, tables.rstrip("/"), out.rstrip("/"), config.get("most_files")))
            details |= {k: str(v) for k, v in told[-1].items()}
    return told


def read(spark: SparkSession, out: str) -> DataFrame:
    """All that was written, deliveries of the same text under their batches."""
    return spark.read.schema(SCHEMA).parquet(f"{out}/texts")


def current(spark: SparkSession, out: str) -> DataFrame:
    """Each text of a key once, from the first batch that had it."""
    return keep_first(read(spark, out), ["feed", "key", "digest"], "batch_id", "part").drop("batch_id")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("--tables", required=True, help="folder with the feeds' tables")
    p.add_argument("--out", required=True, help="folder for texts, checkpoints and the run log")
    p.add_argument("--config", default=str(CONFIG))
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("sanitise").getOrCreate()
    try:
        run(spark, a.tables, a.out, load_config(a.config))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
