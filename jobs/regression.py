"""Batch job: regression of a new system's answers against what the old one recorded.

The old system's orders say what is expected: their status, their customer, and
that no line was shipped before the order. The new system's answers come from
its lines and customers. Each order is a case; its keys are compared, each case
PASSED, FAILED or SKIPPED, and has a numbered record of each divergence:

    OUT/results/period=YYYY-MM/*.parquet

A run over all periods replaces everything. A run over some overwrites these and
leaves the others as they are; one without cases any more gets a row that says
so, which ``read`` leaves out. Reruns give the same rows.

    python -m jobs.regression --tables hdfs://…/tables --out hdfs://…/regression [--periods 1995-01,1995-02] [--config FILE]
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators import verify as vf
from quarrylens.operators.lineage import cut, scratch
from quarrylens.streaming import runlog

log = logging.getLogger("jobs.regression")

NO_CASES = "NO CASES"
CONFIG = Path(__file__).with_suffix(".json")
RECORD = "divergence_id string, case_id bigint, rule_id string, status string, summary string, legacy string, new_system string, source string, blocking boolean"
RESULTS = f"case_id bigint, n_match bigint, n_divergence bigint, n_undecidable bigint, status string, divergences array<struct<{RECORD.replace(' ', ': ').replace(',: ', ', ')}>>, period string"


def load_config(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text())


def cases(orders: DataFrame, periods: list[str] | None = None) -> DataFrame:
    """One case for each order key (of repeated orders the first by customer, status and date) with its period; a null date is period "unknown"."""
    when = F.coalesce(F.date_format("o_orderdate", "yyyy-MM"), F.lit("unknown"))
    if periods:
        # a range of dates that the scan can skip by, then the very periods
        known = sorted(p for p in periods if p != "unknown")
        near = F.lit(False)
        if known:
            near = (F.col("o_orderdate") >= F.to_timestamp(F.lit(f"{known[0]}-01"))) & (F.col("o_orderdate") < F.add_months(F.to_timestamp(F.lit(f"{known[-1]}-01")), 1))
        if "unknown" in periods:
            near = near | F.col("o_orderdate").isNull()
        orders = orders.where(near).where(when.isin(*periods))
    one = orders.where("o_orderkey IS NOT NULL").groupBy("o_orderkey").agg(F.min(F.struct("o_custkey", "o_orderstatus", "o_orderdate")).alias("o"))
    return one.select(F.col("o_orderkey").cast("long").alias("case_id"), "o.*").withColumn("period", when)


def expected(cases: DataFrame) -> DataFrame:
    """(case_id, key, want); what an order does not tell is not expected."""
    want = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("customer"), F.col("o_custkey").cast("string"), F.lit("shipped in time"), F.when(F.col("o_orderdate").isNotNull(), "yes"))
    return cases.select("case_id", F.explode(F.map_filter(want, lambda _, v: v.isNotNull())).alias("key", "want"))


def answers(cases: DataFrame, lineitem: DataFrame, customer: DataFrame) -> DataFrame:
    """(case_id, key, got) from the lines and customers of the new system."""
    # lines are summed up before they meet the cases
    lines = lineitem.groupBy(F.col("l_orderkey").cast("long").alias("case_id")).agg(
        F.count_if(F.col("l_linestatus") == "F").alias("done"), F.count("*").alias("n"), F.min("l_shipdate").alias("first")
    )
    known = customer.select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("there")).distinct()
    both = cases.join(lines, "case_id", "left").join(known, "o_custkey", "left")
    status = F.when(F.col("n").isNotNull(), F.when(F.col("done") == F.col("n"), "F").when(F.col("done") == 0, "O").otherwise("P"))
    in_time = F.when(F.col("first") >= F.col("o_orderdate"), "yes").when(F.col("first") < F.col("o_orderdate"), "no")
    got = F.create_map(F.lit("status"), status, F.lit("customer"), F.when(F.col("there"), F.col("o_custkey").cast("string")), F.lit("shipped in time"), in_time)
    return both.select("case_id", F.explode(F.map_filter(got, lambda _, v: v.isNotNull())).alias("key", "got"))


def run(spark: SparkSession, tables: str, out: str, config: dict | None = None, periods: list[str] | None = None) -> dict:
    """Compares all cases, or those of the given periods; returns counts of cases and divergences."""
    config = config or load_config()
    tables, out = tables.rstrip("/"), out.rstrip("/")
    table = lambda n: spark.read.parquet(f"{tables}/{config['tables'][n]}")
    with runlog.timed(spark, f"{out}/log", "regression", source=tables) as details:
        some = cases(table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"), periods)
        got = answers(some, table("lineitem").select("l_orderkey", "l_linestatus", "l_shipdate"), table("customer").select("c_custkey"))
        with scratch(spark):
            compared = cut(vf.compare_payload(expected(some), got))
            advisory = F.col("rule_id").isin(*config["advisory"])
            about = some.select("case_id", F.lit(None).cast("string").alias("captured_from"), F.lit("legacy database").alias("evidence"), F.lit("high").alias("confidence"))
            nowhere = spark.createDataFrame([], "rule_id string, file string, line int")
            records = vf.divergence_records(compared, about, nowhere).withColumn("blocking", F.col("blocking") & ~advisory)
            lists = records.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(*records.columns))).alias("divergences"))
            rows = vf.case_status(compared).join(some.select("case_id", "period"), "case_id").join(lists, "case_id", "left")
            if periods:
                rows = rows.unionByName(spark.createDataFrame([(p, NO_CASES) for p in periods], "period string, status string"), allowMissingColumns=True)
            mode = "dynamic" if periods else "static"
            rows.hint("rebalance", "period").write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("period").parquet(f"{out}/results")
        results, found = read(spark, out)
        if periods:
            results, found = results.where(F.col("period").isin(*periods)), found.where(F.col("period").isin(*periods))
        counts = {r.status: r["count"] for r in results.groupBy("status").count().collect()}
        told = {"cases": sum(counts.values()), **counts, "divergences": found.count(), "blocking": found.where("blocking").count()}
        details |= {k: str(v) for k, v in told.items()}
    log.info("read orders, lineitem and customer of %s (%s); wrote %s to %s", tables, ", ".join(periods) if periods else "all periods", told, out)
    return told


def read(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """Results (case_id, counts, status, period) and divergence records of all periods."""
    rows = spark.read.schema(RESULTS).parquet(f"{out}/results").where(F.col("status") != NO_CASES)
    return rows.drop("divergences"), rows.select(F.explode("divergences").alias("d"), "period").select("d.*", "period")


def main(argv: list[str] | None = None) -> int:
    """Exit code 0 if nothing blocks, 1 if something does."""
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("--tables", required=True, help="folder with orders, lineitem and customer")
    p.add_argument("--out", required=True)
    p.add_argument("--periods", help="months such as 1995-01, by commas; all by default")
    p.add_argument("--config", default=str(CONFIG))
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("regression").getOrCreate()
    try:
        told = run(spark, a.tables, a.out, load_config(a.config), a.periods.split(",") if a.periods else None)
    finally:
        spark.stop()
    return 1 if told["blocking"] else 0


if __name__ == "__main__":
    raise SystemExit(main())
