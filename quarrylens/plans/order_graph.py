"""The driver's tables as graphs.

Order graph: regions contain nations, nations their customers and suppliers;
customers call orders, orders call parts at line numbers, parts read suppliers,
suppliers depend on nations and these on regions, market segments enter customers. Trade graph: each customer nation points to the
three other supplier nations that earn most from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens.operators.graph import keep_first, merge_call_sites, union

DEPTH, START, HUB_START = 5, "CUST-1", "ORDER-1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    make = lambda df, prefix, key, kind, label: df.select(F.concat(F.lit(prefix + "-"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(label).cast("string").alias("label"))
    # only segments repeat
    segments = keep_first(make(t("customer"), "SEGMENT", "c_mktsegment", "ENTRY", "c_mktsegment").distinct(), ["id"], "label")
    return union(
        make(t("region"), "REGION", "r_regionkey", "FILE", "r_name"),
        make(t("nation"), "NATION", "n_nationkey", "COMPONENT", "n_name"),
        make(t("customer"), "CUST", "c_custkey", "PROCEDURE", "c_name"),
        make(t("supplier"), "SUPP", "s_suppkey", "TABLE", "s_name"),
        make(t("orders"), "ORDER", "o_orderkey", "PROCEDURE", "o_orderkey"),
        make(t("part"), "PART", "p_partkey", "PROCEDURE", "p_name"),
        segments,
    )


def edges(spark: SparkSession, d: str, merged: bool = True) -> DataFrame:
    """kind, source, target, via, call_sites; of order to part one edge for all lines.

    A traversal does not need merged edges: without ``merged`` lines stay single, and nothing is shuffled.
    """
    t = lambda n: table(spark, d, n)
    end = lambda prefix, key: F.concat(F.lit(prefix + "-"), F.col(key).cast("string"))
    plain = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), end(*a).alias("source"), end(*b).alias("target"), F.lit("").alias("via"), F.lit(1).cast("long").alias("call_sites"))
    return union(
        plain(t("nation"), "CONTAINS", ("REGION", "n_regionkey"), ("NATION", "n_nationkey")),
        plain(t("customer"), "CONTAINS", ("NATION", "c_nationkey"), ("CUST", "c_custkey")),
        plain(t("supplier"), "CONTAINS", ("NATION", "s_nationkey"), ("SUPP", "s_suppkey")),
        plain(t("orders"), "CALLS", ("CUST", "o_custkey"), ("ORDER", "o_orderkey")),
        call_sites(spark, d) if merged else plain(t("lineitem"), "CALLS", ("ORDER", "l_orderkey"), ("PART", "l_partkey")),
        plain(t("lineitem").select("l_partkey", "l_suppkey").distinct() if merged else t("lineitem"), "READS", ("PART", "l_partkey"), ("SUPP", "l_suppkey")),
        plain(t("supplier"), "DEPENDS_ON", ("SUPP", "s_suppkey"), ("NATION", "s_nationkey")),
        plain(t("nation"), "DEPENDS_ON", ("NATION", "n_nationkey"), ("REGION", "n_regionkey")),
        plain(t("customer"), "ENTRY_TO", ("SEGMENT", "c_mktsegment"), ("CUST", "c_custkey")),
    )


def call_sites(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    # numbers are grouped, names are made once for each edge
    merged = merge_call_sites(lines.select(F.lit("CALLS").alias("kind"), F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_linenumber").alias("site")))
    return merged.withColumns({"source": F.concat(F.lit("ORDER-"), F.col("source").cast("string")), "target": F.concat(F.lit("PART-"), F.col("target").cast("string"))})


def trade_edges(spark: SparkSession, d: str) -> DataFrame:
    """source, target (nation keys), revenue: three for each customer nation."""
    t = lambda n: table(spark, d, n)
    money = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,2)")
    per = (
        t("lineitem").select("l_orderkey", "l_suppkey", money.alias("m"))
        .join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .where("c_nationkey <> s_nationkey")
        .groupBy(F.col("c_nationkey").alias("source"), F.col("s_nationkey").alias("target"))
        .agg(F.sum("m").alias("revenue"))
    )
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.col("revenue").desc(), "target"))
    return per.withColumn("r", rank).where("r <= 3").select("source", "target", "revenue")


def trade_nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.lit("COMPONENT").alias("kind"), F.col("n_name").alias("label"))


NODES_SQL = """
SELECT 'REGION-' || r_regionkey AS id, 'FILE' AS kind, r_name AS label FROM region
UNION ALL SELECT 'NATION-' || n_nationkey, 'COMPONENT', n_name FROM nation
UNION ALL SELECT 'CUST-' || c_custkey, 'PROCEDURE', c_name FROM customer
UNION ALL SELECT 'SUPP-' || s_suppkey, 'TABLE', s_name FROM supplier
UNION ALL SELECT 'ORDER-' || o_orderkey, 'PROCEDURE', CAST(o_orderkey AS VARCHAR) FROM orders
UNION ALL SELECT 'PART-' || p_partkey, 'PROCEDURE', p_name FROM part
UNION ALL SELECT DISTINCT 'SEGMENT-' || c_mktsegment, 'ENTRY', c_mktsegment FROM customer
"""

EDGES_SQL = """
SELECT 'CONTAINS' AS kind, 'REGION-' || n_regionkey AS source, 'NATION-' || n_nationkey AS target, '' AS via, CAST(1 AS BIGINT) AS call_sites FROM nation
UNION ALL SELECT 'CONTAINS', 'NATION-' || c_nationkey, 'CUST-' || c_custkey, '', 1 FROM customer
UNION ALL SELECT 'CONTAINS', 'NATION-' || s_nationkey, 'SUPP-' || s_suppkey, '', 1 FROM supplier
UNION ALL SELECT 'CALLS', 'CUST-' || o_custkey, 'ORDER-' || o_orderkey, '', 1 FROM orders
UNION ALL SELECT 'CALLS', 'ORDER-' || l_orderkey, 'PART-' || l_partkey, array_to_string(list_sort(list(DISTINCT l_linenumber)), ','), CAST(count(DISTINCT l_linenumber) AS BIGINT) FROM lineitem GROUP BY l_orderkey, l_partkey
UNION ALL SELECT DISTINCT 'READS', 'PART-' || l_partkey, 'SUPP-' || l_suppkey, '', 1 FROM lineitem
UNION ALL SELECT 'DEPENDS_ON', 'SUPP-' || s_suppkey, 'NATION-' || s_nationkey, '', 1 FROM supplier
UNION ALL SELECT 'DEPENDS_ON', 'NATION-' || n_nationkey, 'REGION-' || n_regionkey, '', 1 FROM nation
UNION ALL SELECT 'ENTRY_TO', 'SEGMENT-' || c_mktsegment, 'CUST-' || c_custkey, '', 1 FROM customer
"""

TRADE_SQL = """
SELECT source, target, revenue FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY revenue DESC, target) AS r FROM (
    SELECT c_nationkey AS source, s_nationkey AS target, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)
) WHERE r <= 3
"""
