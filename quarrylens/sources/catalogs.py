"""Catalogs: the log of rules and reviews as tables; rules, golden cases and language guidance as YAML, small files that the driver reads and writes."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators.graph import keep_first
from quarrylens.operators.lineage import exists
from quarrylens.operators.rules import review

RULE_SCHEMA = "rule_id string, name string, description string, flow_id string, entry_point_id string, status string, confidence string, condition_type string, expression string, fields array<string>, behavior_type string, target string, observation array<string>, inference array<string>, file string, line int, procedures array<string>, reviewed_by string, review_note string, reviewed_at string"
CASE_SCHEMA = "case_id string, flow_id string, entry_point string, procedure string, description string, inputs map<string,string>, expected map<string,string>, legacy_output map<string,string>, state_trace array<string>, captured_from string, evidence string, confidence string, tags array<string>"

# What counts as evidence of a recorded case.
EVIDENCE = ("query do SGBD", "observação manual", "observacao manual", "execução do legado", "execucao do legado", "database trace", "manual observation", "legacy execution")


class CatalogError(ValueError):
    """A catalog that cannot be used; the message says why."""


def _names(schema: str) -> list[str]:
    out, depth, word = [], 0, ""
    for c in schema + ",":
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append(word.split()[0])
            word = ""
        else:
            word += c
    return out


def _frame(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    names = _names(schema)
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def load_rules(spark: SparkSession, path: str, system_id: str) -> DataFrame:
    """The rules of a system; a missing file is an empty catalog, another system's is refused."""
    p = Path(path)
    data = yaml.safe_load(p.read_text()) if p.exists() else None
    if data and data.get("system_id") != system_id:
        raise CatalogError(f"{path} belongs to {data.get('system_id')!r}, not to {system_id!r}")
    return _frame(spark, (data or {}).get("rules") or [], RULE_SCHEMA)


def save_rules(rules: DataFrame, path: str, system_id: str) -> None:
    """Reviewed catalogs are small; they are sorted by id."""
    names = [n for n in _names(RULE_SCHEMA) if n in rules.columns]
    rows = [{k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in rules.select(*names).orderBy("rule_id").collect()]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.safe_dump({"version": 1, "system_id": system_id, "rules": rows}, sort_keys=False, allow_unicode=True))


DECISION_SCHEMA = "rule_id string, decision string, reviewer string, at string, note string"


class RuleLog:
    """The rules of a system as two append-only tables: rules as they were extracted, and decisions about them.

    Writers only add files, so none loses what another one adds. Of a rule that was
    added twice the first counts; decisions are replayed in the order of their times.
    """

    def __init__(self, spark: SparkSession, path: str, system_id: str):
        self.spark, self.path, self.system_id = spark, path.rstrip("/"), system_id

    def _read(self, table: str, schema: str) -> DataFrame:
        path = f"{self.path}/{table}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def rules(self) -> DataFrame:
        """The catalog as it stands."""
        added = self._read("rules", f"{RULE_SCHEMA}, system_id string, added timestamp")
        other = added.where(F.col("system_id") != self.system_id).limit(1).collect()
        if other:
            raise CatalogError(f"{self.path} belongs to {other[0].system_id!r}, not to {self.system_id!r}")
        first = keep_first(added, ["rule_id"], "added", F.xxhash64(*_names(RULE_SCHEMA))).drop("system_id", "added")
        return review(first, self._read("decisions", DECISION_SCHEMA), strict=False).select(*_names(RULE_SCHEMA))

    def add(self, rules: DataFrame) -> None:
        """Those whose ids the catalog lacks; columns that are missing are null."""
        have = dict(rules.dtypes)
        types = {f.name: f.dataType for f in self.spark.createDataFrame([], RULE_SCHEMA).schema}
        new = rules.join(self.rules().select("rule_id"), "rule_id", "left_anti")
        new = new.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in types.items()], F.lit(self.system_id).alias("system_id"), F.current_timestamp().alias("added"))
        new.write.mode("append").parquet(f"{self.path}/rules")

    def decide(self, decisions: DataFrame) -> None:
        """Adds decisions (rule_id, decision, reviewer, at, note); unknown ones, and those without a reviewer, are refused."""
        review(self.spark.createDataFrame([], "rule_id string, status string, confidence string"), decisions)
        decisions.select(*_names(DECISION_SCHEMA)).write.mode("append").parquet(f"{self.path}/decisions")


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases, from a list or a mapping with ``cases``; each needs accepted evidence and something expected."""
    data = yaml.safe_load(Path(path).read_text()) or []
    cases = data.get("cases", []) if isinstance(data, dict) else data
    rows = []
    accepted = {e.strip().lower() for e in EVIDENCE}
    text = lambda v: "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    texts = lambda m: {k: text(v) for k, v in (m or {}).items()}
    for c in cases:
        row = {
            **c,
            "case_id": c.get("case_id") or c.get("id"),
            "inputs": texts(c.get("inputs", c.get("in_params"))),
            "expected": texts(c.get("expected", c.get("out_params"))),
            "legacy_output": texts(c.get("legacy_output")),
            "state_trace": c.get("state_trace") or [],
            "confidence": c.get("confidence") or "high",
        }
        if str(row.get("evidence") or "").strip().lower() not in accepted:
            raise CatalogError(f"case {row['case_id']}: evidence {row.get('evidence')!r} is not accepted")
        if not (row["expected"] or row["legacy_output"] or row["state_trace"]):
            raise CatalogError(f"case {row['case_id']} expects nothing")
        rows.append(row)
    return _frame(spark, rows, CASE_SCHEMA)


def save_cases(cases: DataFrame, path: str, system_id: str) -> None:
    rows = [{k: v for k, v in r.asDict(recursive=True).items() if v not in (None, [], {})} for r in cases.orderBy("case_id").collect()]
    Path(path).write_text(yaml.safe_dump({"system_id": system_id, "cases": rows}, sort_keys=False, allow_unicode=True))


def load_guidance(spark: SparkSession, root: str) -> DataFrame:
    """One row for each language folder with a schema.yaml; planned languages are not implemented."""
    rows = []
    for p in sorted(Path(root).glob("*/schema.yaml")):
        d = yaml.safe_load(p.read_text()) or {}
        rows.append({"language": d.get("language", p.parent.name), "reference_parser": d.get("reference_parser"), "fallback_parser": d.get("fallback_parser"), "capabilities": {k: str(v) for k, v in (d.get("capabilities") or {}).items()}, "attention_points": [str(x) for x in d.get("attention_points") or []], "implemented": d.get("status") != "planned"})
    return _frame(spark, rows, "language string, reference_parser string, fallback_parser string, capabilities map<string,string>, attention_points array<string>, implemented boolean")
