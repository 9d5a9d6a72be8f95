"""The run log: JSON lines, appended by every stage, read as a batch or a stream."""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions.text import redact

SCHEMA = "stage string, execution_id string, system_id string, flow_id string, rule_id string, source string, timestamp string, duration_ms double, provider string, model string, prompt_version string, input_token_estimate long, output_token_estimate long, details map<string,string>"


def parse(lines: DataFrame) -> DataFrame:
    """Records of JSON lines (value); what is no JSON becomes a record of nulls."""
    return lines.select(F.from_json("value", SCHEMA).alias("r")).select("r.*")


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.readStream.schema("value string").text(path))


def stage_stats(records: DataFrame, slow_ms: float = 1000.0) -> DataFrame:
    """Records, slow ones and executions of each stage."""
    return records.groupBy("stage").agg(F.count("*").alias("n"), F.count_if(F.col("duration_ms") > slow_ms).alias("n_slow"), F.countDistinct("execution_id").alias("n_runs"))


def stage_counts(records: DataFrame) -> DataFrame:
    """Counts that a stream can keep up to date: records and time of each stage."""
    return records.groupBy("stage").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"))


def by_stage(records: DataFrame, stage: str) -> DataFrame:
    return records.where(F.col("stage") == stage)


def model_records(records: DataFrame) -> DataFrame:
    return records.where("provider IS NOT NULL")


def append(records: DataFrame, path: str) -> None:
    """Appends records as JSON lines, secrets taken out of every text on the way."""
    texts = [c for c, t in records.dtypes if t == "string"]
    records.select(F.to_json(F.struct(*[redact(c).alias(c) if c in texts else F.col(c) for c in records.columns])).alias("value")).select(redact("value").alias("value")).write.mode("append").text(path)


@contextmanager
def timed(spark: SparkSession, path: str, stage: str, **fields):
    """Writes one record when the work ends, with its real duration, and the error's name if it failed."""
    began, details = time.monotonic(), {}
    record = {"stage": stage, "execution_id": f"EXEC-{uuid.uuid4().hex[:12]}", "timestamp": datetime.now(timezone.utc).isoformat(), "details": details} | fields
    try:
        yield details
    except Exception as e:
        details["error"] = type(e).__name__
        raise
    finally:
        record["duration_ms"] = (time.monotonic() - began) * 1000
        names = [x.strip().split(" ")[0] for x in SCHEMA.replace("map<string,string>", "map").split(",")]
        append(spark.createDataFrame([tuple(record.get(n) for n in names)], SCHEMA), path)
