"""The jobs as queries: each runs twice into a new folder under spark.checkpoint.dir and gives its whole output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import regression, sanitise
from quarrylens.operators.lineage import shared_dir
from quarrylens.plans.domain_queries import redact_sql, slug_sql


def _folder(spark: SparkSession, job: str) -> str:
    return f"{shared_dir(spark)}/jobs/{job}-{uuid.uuid4().hex}"


def job1_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents and pages without secrets; the second run finds nothing new."""
    out = _folder(spark, "sanitise")
    for _ in range(2):
        sanitise.run(spark, sf_dir, out)
    return sanitise.current(spark, out)


def job2_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of each order, with its divergences in one line; the second run overwrites each period with the same rows."""
    out = _folder(spark, "regression")
    for _ in range(2):
        regression.run(spark, sf_dir, out)
    results, records = regression.read(spark, out)
    lines = records.groupBy("case_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "divergence_id", "status", "summary"))), "; ").alias("divergences"), F.count_if("blocking").alias("n_blocking")
    )
    return results.join(lines, "case_id", "left").na.fill(0, ["n_blocking"])


def _texts(feed: str, key: str, column: str, part: str, table: str) -> str:
    marks = "CAST(len(regexp_extract_all({0}, '\\[REDACTED\\]')) AS BIGINT)"
    return f"""SELECT '{feed}' AS feed, {key} AS key, sha256(raw) AS digest, safe AS text, {marks.format('safe')} - {marks.format('raw')} AS n_redacted,
  CAST((length(raw) + 3) // 4 AS BIGINT) AS tokens_before, CAST((length(safe) + 3) // 4 AS BIGINT) AS tokens_after, part
  FROM (SELECT {key}, {column} AS raw, {redact_sql(column)} AS safe, {part} AS part FROM {table})"""


QUERIES = {f.__name__: f for f in (job1_sanitise, job2_regression)}
SQL = {
    "job1_sanitise": f"SELECT DISTINCT * FROM ({_texts('documents', 'doc_id', 'text', slug_sql('source'), 'documents')} UNION ALL {_texts('pages', 'page_id', 'html', chr(39) + 'ALL' + chr(39), 'pages')})",
    "job2_regression": """WITH l AS (SELECT l_orderkey AS id, count(*) FILTER (l_linestatus = 'F') AS done, count(*) AS n, min(l_shipdate) AS first FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey AS case_id, strftime(o_orderdate, '%Y-%m') AS period, o_orderstatus AS w1, CASE WHEN n IS NULL THEN NULL WHEN done = n THEN 'F' WHEN done = 0 THEN 'O' ELSE 'P' END AS g1,
  CAST(o_custkey AS VARCHAR) AS w2, CAST(c_custkey AS VARCHAR) AS g2, 'yes' AS w3, CASE WHEN first >= o_orderdate THEN 'yes' WHEN first < o_orderdate THEN 'no' END AS g3
  FROM orders LEFT JOIN l ON id = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey),
u AS (SELECT case_id, period, 'status' AS key, w1 AS want, g1 AS got FROM b UNION ALL SELECT case_id, period, 'customer', w2, g2 FROM b UNION ALL SELECT case_id, period, 'shipped in time', w3, g3 FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY key) AS i FROM u WHERE got IS NULL OR got <> want),
t AS (SELECT case_id, string_agg('DIV-' || case_id || '-' || printf('%02d', i) || CASE WHEN got IS NULL THEN ' MISSING_IN_NEW ' || key || ': missing in the new system (expected ' || want || ')'
    ELSE ' REQUIRES_REVIEW ' || key || ': expected ' || want || ', got ' || got END, '; ' ORDER BY i) AS divergences, count(*) FILTER (key <> 'shipped in time') AS n_blocking, count(*) AS n FROM d GROUP BY case_id)
SELECT b.case_id, 3 - coalesce(n, 0) AS n_match, coalesce(n, 0) AS n_divergence, CAST(0 AS BIGINT) AS n_undecidable, CASE WHEN n > 0 THEN 'FAILED' ELSE 'PASSED' END AS status, period, divergences, coalesce(n_blocking, 0) AS n_blocking
FROM b LEFT JOIN t USING (case_id)""",
}
