"""Answers of a new system over HTTP, for Engine.verify."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.text import coerce


def post(url: str, body: dict, timeout: float) -> dict:
    """The JSON object that answers a POST; a status of 400 and more is an error with its number."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read() or b"{}") or {}
    except urllib.error.HTTPError as e:
        raise RuntimeError(f"the new system answered with HTTP {e.code}") from e


def http_answers(base_url: str, timeout: float = 10.0, send: Callable[[str, dict, float], dict] = post) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A function for Engine.verify that asks the system at ``base_url`` about each case; without a URL it refuses."""
    if not base_url:
        raise ValueError("no URL of the new system: set QUARRYLENS_NEW_SYSTEM_URL or use the rule simulator")
    url = f"{base_url.rstrip('/')}/verify"

    def ask(cases: DataFrame, rules: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                rows = []
                for case, flow, inputs in zip(x["case_id"], x["flow_id"], x["inputs"]):
                    got = send(url, {"case_id": case, "flow_id": flow, "inputs": dict(inputs or {})}, timeout)
                    rows += [(case, str(k), None if v is None else json.dumps(v) if isinstance(v, (bool, dict, list)) else str(v)) for k, v in got.items()]
                yield pd.DataFrame(rows, columns=["case_id", "rule_id", "got"])

        kind = dict(cases.dtypes)["case_id"]
        answers = cases.select("case_id", "flow_id", "inputs").mapInPandas(run, f"case_id {kind}, rule_id string, got string")
        return answers.withColumn("got", coerce(F.col("got")))

    return ask
