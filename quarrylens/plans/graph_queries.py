"""Graph queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens.operators import graph as g
from quarrylens.operators import slices as sl
from quarrylens.operators.betweenness import betweenness
from quarrylens.operators.lineage import cut
from quarrylens.plans import order_graph as og

QUERIES: dict = {}
SQL: dict[str, str] = {}

WITH_GRAPH = f"n AS ({og.NODES_SQL}), e AS ({og.EDGES_SQL})"
#: written out, so that the SQL does not follow a mistake: flows go from customers by orders, parts and suppliers to nations, never to what only contains, nor to regions
STEPS = "(SELECT source, target FROM e WHERE (kind = 'CALLS' OR kind = 'READS' OR kind = 'ENTRY_TO' OR kind = 'DEPENDS_ON') AND target NOT LIKE 'REGION-%')"
#: kinds of nodes that can be hubs
STRUCTURAL = ("COMPONENT", "PROCEDURE", "TABLE")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(og.NODES_SQL)
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return og.nodes(spark, d)


@query(f"SELECT 'EDGE-' || kind || '-' || source || '-' || target AS id, * FROM ({og.EDGES_SQL})")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return og.edges(spark, d).withColumn("id", F.concat_ws("-", F.lit("EDGE"), "kind", "source", "target"))


@query("""SELECT 'CALLS' AS kind, 'ORDER-' || l_orderkey AS source, 'PART-' || l_partkey AS target,
  array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS via, CAST(count(DISTINCT l_linenumber) AS BIGINT) AS call_sites
FROM lineitem GROUP BY l_orderkey, l_partkey""")
def call_site_merge(spark: SparkSession, d: str) -> DataFrame:
    return og.call_sites(spark, d)


@query("""SELECT 'EVENT-' || event_id AS source, 'CUST-' || (user_id * 11) AS target FROM events
WHERE user_id * 11 IN (SELECT c_custkey FROM customer) AND event_type <> 'error'""")
def dangling_edges_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Edges from events to customers, many of whom do not exist; errors are no nodes."""
    events, customer = og.table(spark, d, "events"), og.table(spark, d, "customer")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    edges = events.select(name("EVENT-", F.col("event_id")).alias("source"), name("CUST-", F.col("user_id") * 11).alias("target"))
    nodes = events.where("event_type <> 'error'").select(name("EVENT-", F.col("event_id")).alias("id")).unionAll(customer.select(name("CUST-", F.col("c_custkey")).alias("id")))
    return g.admit(edges, nodes)


@query(f"""WITH {WITH_GRAPH}, i AS (
  SELECT source AS id FROM e UNION ALL SELECT target FROM e WHERE target <> source
), d AS (SELECT id, count(*) AS degree FROM i GROUP BY id), b AS (
  SELECT DISTINCT source AS id, target AS o FROM e UNION SELECT target, source FROM e
), c AS (SELECT id, count(DISTINCT o) AS neighbours FROM b GROUP BY id)
SELECT n.id, coalesce(degree, 0) AS degree, coalesce(neighbours, 0) AS neighbours FROM n LEFT JOIN d USING (id) LEFT JOIN c USING (id)""")
def node_degree(spark: SparkSession, d: str) -> DataFrame:
    return g.node_degree(og.nodes(spark, d), og.edges(spark, d))


CENTRAL = f"""{WITH_GRAPH}, s AS (SELECT DISTINCT source, target FROM e), l AS (
  SELECT id, count(*) AS links FROM (SELECT source AS id FROM s UNION ALL SELECT target FROM s) GROUP BY id
), c AS (
  SELECT n.id, kind, label, coalesce(links, 0) AS links, coalesce(links, 0) / (SELECT count(*) - 1 FROM n) AS centrality FROM n LEFT JOIN l USING (id)
)"""


@query(f"WITH {CENTRAL} SELECT id, links, round(centrality, 6) AS centrality FROM c")
def degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    return g.degree_centrality(og.nodes(spark, d), og.edges(spark, d)).select("id", "links", F.round("centrality", 6).alias("centrality"))


HUBS = f"""{CENTRAL}, k AS (SELECT * FROM c WHERE kind IN ('COMPONENT', 'PROCEDURE', 'TABLE')), hub AS (
  SELECT *, row_number() OVER (ORDER BY links DESC, id) AS rank FROM k
  WHERE links > 1 AND links >= 0.6 * (SELECT max(links) FROM k)
)"""


@query(f"WITH {HUBS} SELECT 'HUB-' || upper(label) || '-' || CASE WHEN rank <= 10 THEN '0' ELSE '' END || (rank - 1) AS hub_id, id, links, round(centrality, 6) AS centrality, rank FROM hub")
def hubs(spark: SparkSession, d: str) -> DataFrame:
    return _hubs(spark, d).select("hub_id", "id", "links", F.round("centrality", 6).alias("centrality"), "rank")


def _hubs(spark: SparkSession, d: str) -> DataFrame:
    return g.hubs(g.degree_centrality(og.nodes(spark, d), og.edges(spark, d)), list(STRUCTURAL))


@query(f"""WITH RECURSIVE t AS ({og.TRADE_SQL}), w(s, v, d) AS (
  SELECT source, target, 1 FROM t UNION ALL SELECT w.s, t.target, w.d + 1 FROM w JOIN t ON t.source = w.v WHERE w.d < 6
), m AS (SELECT s, v, min(d) AS d FROM w WHERE s <> v GROUP BY s, v), p AS (
  SELECT w.s, w.v, w.d, CAST(count(*) AS DOUBLE) AS n FROM w JOIN m ON w.s = m.s AND w.v = m.v AND w.d = m.d GROUP BY 1, 2, 3
), b AS (
  SELECT a.v AS id, sum(a.n * b.n / c.n) AS x FROM p a JOIN p b ON a.v = b.s AND a.s <> b.v JOIN p c ON c.s = a.s AND c.v = b.v AND c.d = a.d + b.d GROUP BY a.v
)
SELECT n_nationkey AS id, round(coalesce(x, 0) / ((SELECT count(*) - 1 FROM nation) * (SELECT count(*) - 2 FROM nation)), 6) AS betweenness FROM nation LEFT JOIN b ON id = n_nationkey""")
def betweenness_trade(spark: SparkSession, d: str) -> DataFrame:
    return betweenness(og.trade_nodes(spark, d), og.trade_edges(spark, d)).select("id", F.round("betweenness", 6).alias("betweenness"))


#: shortest paths by levels over the order graph up to its orders; from a supplier over nations and a region to an order it is five steps
_LEVEL = """p{1} AS (SELECT p.s, t.target AS v, {1} AS d, sum(p.n) AS n FROM p{0} p JOIN t ON t.source = p.v WHERE t.target <> p.s AND NOT EXISTS (SELECT 1 FROM ({2}) k WHERE k.s = p.s AND k.v = t.target) GROUP BY 1, 2)"""
_LEVELS = [_LEVEL.format(i, i + 1, " UNION ALL ".join(f"SELECT s, v FROM p{j}" for j in range(1, i + 1))) for i in range(1, 7)]
NO_PARTS = f"""{WITH_GRAPH}, nn AS (SELECT * FROM n WHERE id NOT LIKE 'PART-%'), t AS (SELECT DISTINCT source, target FROM e WHERE source NOT LIKE 'PART-%' AND target NOT LIKE 'PART-%'),
p1 AS (SELECT source AS s, target AS v, 1 AS d, CAST(1 AS DOUBLE) AS n FROM t), {', '.join(_LEVELS)},
p AS ({' UNION ALL '.join(f'SELECT s, v, d, n FROM p{i}' for i in range(1, 8))}), b AS (
  SELECT a.v AS id, sum(a.n * b.n / c.n) AS x FROM p a JOIN p b ON a.v = b.s AND a.s <> b.v JOIN p c ON c.s = a.s AND c.v = b.v AND c.d = a.d + b.d GROUP BY a.v
), bt AS (SELECT nn.id, kind, label, coalesce(x, 0) / ((SELECT count(*) - 1 FROM nn) * (SELECT count(*) - 2 FROM nn)) AS betweenness FROM nn LEFT JOIN b USING (id))"""


def _no_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The order graph up to its orders."""
    return og.nodes(spark, d).where("id NOT LIKE 'PART-%'"), og.edges(spark, d, merged=False).where("source NOT LIKE 'PART-%' AND target NOT LIKE 'PART-%'")


@query(f"WITH {NO_PARTS} SELECT id, round(betweenness, 9) AS betweenness FROM bt")
def betweenness_orders(spark: SparkSession, d: str) -> DataFrame:
    """Of regions, nations, suppliers, customers, segments and orders: all orders and suppliers are taken off, customers of one nation and segment are one class."""
    nodes, edges = _no_parts(spark, d)
    return betweenness(nodes, edges).select("id", F.round("betweenness", 9).alias("betweenness"))


@query(f"""WITH {NO_PARTS}, l AS (SELECT id, count(*) AS links FROM (SELECT source AS id FROM t UNION ALL SELECT target FROM t) GROUP BY id),
k AS (SELECT * FROM bt JOIN l USING (id) WHERE kind IN ('COMPONENT', 'PROCEDURE', 'TABLE')),
hub AS (SELECT *, row_number() OVER (ORDER BY links DESC, round(betweenness, 12) DESC, id) AS rank FROM k WHERE links > 1 AND links >= 0.6 * (SELECT max(links) FROM k))
SELECT 'HUB-' || upper(label) || '-' || printf('%02d', rank - 1) AS hub_id, id, links, round(betweenness, 9) AS betweenness, rank FROM hub""")
def hubs_by_betweenness(spark: SparkSession, d: str) -> DataFrame:
    """Hubs of the order graph up to its orders; nations with as many links rank by betweenness."""
    nodes, edges = _no_parts(spark, d)
    found = g.hubs(g.degree_centrality(nodes, edges), list(STRUCTURAL), betweenness(nodes, edges))
    return found.select("hub_id", "id", "links", F.round("betweenness", 9).alias("betweenness"), "rank")


def _slice_sql(start: str, depth: int) -> str:
    return f"""r(id, d) AS (
  SELECT '{start}', 0 UNION SELECT s.target, r.d + 1 FROM r JOIN {STEPS} s ON s.source = r.id WHERE r.d < {depth}
), slice AS (SELECT id, CAST(min(d) AS BIGINT) AS distance FROM r GROUP BY id)"""


SLICE = f"{WITH_GRAPH}, {_slice_sql(og.START, og.DEPTH)}"


def _slice(spark: SparkSession, d: str, start: str = og.START, depth: int = og.DEPTH) -> tuple[DataFrame, DataFrame]:
    edges = og.edges(spark, d, merged=False)
    # written down once for all levels
    followed = cut(edges.where(F.col("kind").isin(*g.TRAVERSED)).select("source", "target"))
    return g.reach(followed, spark.createDataFrame([(start,)], "id string"), depth, cut(og.nodes(spark, d).where(F.col("kind").isin(*g.IN_FLOW)).select("id"))), edges


@query(f"WITH RECURSIVE {SLICE} SELECT id, distance FROM slice")
def slice_forward(spark: SparkSession, d: str) -> DataFrame:
    return _slice(spark, d)[0]


@query(f"WITH RECURSIVE {SLICE} SELECT kind, source, target FROM e WHERE source IN (SELECT id FROM slice) AND target IN (SELECT id FROM slice)")
def slice_induced_edges(spark: SparkSession, d: str) -> DataFrame:
    reached, edges = _slice(spark, d)
    return g.induced(edges, reached).select("kind", "source", "target").distinct()


@query(f"WITH RECURSIVE {SLICE} SELECT {og.DEPTH} AS depth, count(*) AS n_nodes, max(distance) AS max_distance, max(distance) = {og.DEPTH} AS truncated FROM slice UNION ALL SELECT 2, count(*), max(distance), max(distance) = 2 FROM slice WHERE distance <= 2")
def slice_truncated(spark: SparkSession, d: str) -> DataFrame:
    """To the bound and to where nothing follows."""
    one = lambda depth: g.truncated(_slice(spark, d, depth=depth)[0], depth).select(F.lit(depth).alias("depth"), "*")
    return one(og.DEPTH).unionAll(one(2))


@query(f"""WITH RECURSIVE t AS ({og.TRADE_SQL}), b AS (SELECT source, target FROM t UNION SELECT target, source FROM t), r(id, d) AS (
  SELECT 0, 0 UNION SELECT b.target, r.d + 1 FROM r JOIN b ON b.source = r.id WHERE r.d < 2
) SELECT id, CAST(min(d) AS BIGINT) AS distance FROM r GROUP BY id""")
def slice_undirected(spark: SparkSession, d: str) -> DataFrame:
    both = cut(g.both_ways(og.trade_edges(spark, d)).distinct())
    return g.reach(both, spark.createDataFrame([(0,)], "id int"), 2)


HUB_SLICE = f"{HUBS}, {_slice_sql(og.HUB_START, og.DEPTH)}"


@query(f"WITH RECURSIVE {HUB_SLICE} SELECT id, rank FROM hub WHERE id IN (SELECT id FROM slice)")
def slice_hub_refs(spark: SparkSession, d: str) -> DataFrame:
    return _hubs(spark, d).join(_slice(spark, d, og.HUB_START)[0].select("id"), "id", "left_semi").select("id", "rank")


@query(f"WITH RECURSIVE {HUB_SLICE} SELECT id, rank FROM hub WHERE id NOT IN (SELECT id FROM slice)")
def slice_excluded_hubs(spark: SparkSession, d: str) -> DataFrame:
    return _hubs(spark, d).join(_slice(spark, d, og.HUB_START)[0].select("id"), "id", "left_anti").select("id", "rank")


#: every customer is an entry; orders, parts and suppliers follow
ALL_DEPTH = 3
ALL = f"""{WITH_GRAPH}, r(entry, id, d) AS (
  SELECT id, id, 0 FROM n WHERE id LIKE 'CUST-%' UNION SELECT r.entry, s.target, r.d + 1 FROM r JOIN {STEPS} s ON s.source = r.id WHERE r.d < {ALL_DEPTH}
), sl AS (SELECT entry, id, CAST(min(d) AS BIGINT) AS distance FROM r GROUP BY entry, id)"""


def _slices(spark: SparkSession, d: str, each=None) -> DataFrame:
    nodes = og.nodes(spark, d)
    followed = og.edges(spark, d, merged=False).where(F.col("kind").isin(*g.TRAVERSED))
    starts = nodes.where("id LIKE 'CUST-%'").select(F.col("id").alias("entry"), "id")
    return sl.reach_all(followed, starts, ALL_DEPTH, nodes.where(F.col("kind").isin(*g.IN_FLOW)).select("id"), each)


@query(f"WITH RECURSIVE {ALL} SELECT entry, id, distance FROM sl")
def slices_all(spark: SparkSession, d: str) -> DataFrame:
    """The slices of all customers, one pass for each level."""
    return _slices(spark, d)


@query(f"""WITH RECURSIVE {ALL}, m AS (SELECT 'SUPP-' || s_suppkey AS node, 'NATION-' || s_nationkey AS root FROM supplier UNION ALL SELECT 'PART-' || p_partkey, 'SIZE-' || p_brand || p_size FROM part),
z AS (SELECT root, count(*) AS size FROM m GROUP BY root), w AS (SELECT entry, root, count(*) AS k FROM sl JOIN m ON node = id GROUP BY 1, 2), c AS (SELECT entry, count(*) AS n_clusters FROM w JOIN z USING (root) WHERE k = size GROUP BY entry),
x AS (SELECT entry, count(*) AS n_nodes, count(*) FILTER (kind = 'PROCEDURE') AS n_procedures, 0 AS n_sql, count(*) FILTER (kind = 'TABLE') AS n_objects, max(distance) AS max_distance,
  CAST(sum(CASE WHEN kind = 'PROCEDURE' THEN (length(label) + 3) // 4 ELSE 0 END) AS BIGINT) AS tokens FROM sl JOIN n USING (id) GROUP BY entry)
SELECT x.*, coalesce(n_clusters, 0) AS n_clusters, max_distance = {ALL_DEPTH} AS truncated, CASE WHEN max_distance = {ALL_DEPTH} THEN 'more may lie beyond the bound' ELSE '' END AS warnings FROM x LEFT JOIN c USING (entry)""")
def slice_summaries(spark: SparkSession, d: str) -> DataFrame:
    """What each customer's slice holds; clusters are the suppliers of a nation, and parts of one brand and size."""
    nodes = og.nodes(spark, d)
    texts = nodes.where("kind = 'PROCEDURE'").select("id", F.expr("(length(label) + 3) DIV 4").alias("tokens"))
    member = lambda t, name, root: og.table(spark, d, t).select(F.concat(*name).alias("node"), F.concat(*root).alias("root"))
    members = member("supplier", (F.lit("SUPP-"), F.col("s_suppkey").cast("string")), (F.lit("NATION-"), F.col("s_nationkey").cast("string")))
    members = members.unionAll(member("part", (F.lit("PART-"), F.col("p_partkey").cast("string")), (F.lit("SIZE-"), F.col("p_brand"), F.col("p_size").cast("string"))))
    return _slices(spark, d, lambda some: sl.summaries(some, nodes, ALL_DEPTH, texts, members))


#: from each line's part to that of the next line of its order, if they share a brand
NEXT_PARTS = """f AS (SELECT DISTINCT source, target FROM (SELECT l_partkey AS source, p_brand AS b, lead(l_partkey) OVER w AS target, lead(p_brand) OVER w AS nb
  FROM lineitem JOIN part ON p_partkey = l_partkey WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) WHERE b = nb AND source <> target)"""


def _next_parts(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = og.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(og.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    nxt = lines.select(F.col("l_partkey").alias("source"), F.col("p_brand").alias("b"), F.lead("l_partkey").over(w).alias("target"), F.lead("p_brand").over(w).alias("nb"))
    return nxt.where("b = nb AND source <> target").select("source", "target").distinct()


@query(f"""WITH RECURSIVE {NEXT_PARTS}, r(s, v) AS (SELECT source, target FROM f UNION SELECT r.s, f.target FROM r JOIN f ON f.source = r.v),
x AS (SELECT source AS node FROM f UNION SELECT target FROM f), b AS (SELECT a.s AS node, min(a.v) AS m FROM r a JOIN r b ON a.s = b.v AND a.v = b.s GROUP BY a.s)
SELECT node, least(node, coalesce(m, node)) AS root FROM x LEFT JOIN b USING (node)""")
def strong_components_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts that lead to each other by next lines of one brand."""
    return sl.strong_components(_next_parts(spark, d))


@query(f"""WITH RECURSIVE {NEXT_PARTS}, r(entry, id) AS (SELECT p_brand, p_partkey FROM part WHERE p_size = 1 UNION SELECT r.entry, f.target FROM r JOIN f ON f.source = r.id) SELECT entry, id FROM r""")
def reachable_parts(spark: SparkSession, d: str) -> DataFrame:
    """All parts that those of size 1 lead to, by brand, without a bound."""
    starts = og.table(spark, d, "part").where("p_size = 1").select(F.col("p_brand").alias("entry"), F.col("p_partkey").alias("id"))
    return sl.reachable(cut(_next_parts(spark, d)), starts)


LINES = """l AS (SELECT DISTINCT doc_id, md5(line) AS h FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 20),
m AS (SELECT h, min(doc_id) AS first FROM l GROUP BY h), e AS (SELECT DISTINCT l.doc_id AS source, m.first AS target FROM l JOIN m USING (h) WHERE l.doc_id <> m.first)"""
COMPONENTS = f"""{LINES}, b AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.b, r.root FROM r JOIN b ON b.a = r.node WHERE r.root < b.b),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)"""


def line_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each document to the first that has the same line of at least 20 characters."""
    lines = og.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") >= 20)
    lines = lines.select("doc_id", F.md5("line").alias("h")).distinct()
    first = lines.groupBy("h").agg(F.min("doc_id").alias("target"), F.count("*").alias("n")).where("n > 1")
    # lines that stand in one document only drop out before the join's output
    return cut(lines.join(first, "h").where("doc_id <> target").select(F.col("doc_id").alias("source"), "target").distinct())


def line_components(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    edges = line_edges(spark, d)
    nodes = og.table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return g.communities(nodes, edges)[0], edges


@query(f"WITH RECURSIVE {COMPONENTS} SELECT node, root FROM c")
def duplicate_components(spark: SparkSession, d: str) -> DataFrame:
    return line_components(spark, d)[0]


STATS = f"""{COMPONENTS}, s AS (SELECT root, count(*) AS size, min(node) AS first FROM c GROUP BY root),
i AS (SELECT x.root, count(*) AS n FROM e JOIN c x ON x.node = e.source JOIN c y ON y.node = e.target WHERE x.root = y.root GROUP BY x.root),
st AS (SELECT s.root, row_number() OVER (ORDER BY size DESC, first) - 1 AS idx, size, round(size / (SELECT count(*) FROM c), 6) AS share,
  round(CASE WHEN size > 1 THEN coalesce(n, 0) / (size * (size - 1)) ELSE 0 END, 6) AS cohesion, size / (SELECT count(*) FROM c) > 0.5 AS is_giant FROM s LEFT JOIN i USING (root))"""


def _stats(spark: SparkSession, d: str) -> DataFrame:
    members, edges = line_components(spark, d)
    return g.cluster_stats(cut(members), edges).withColumns({"share": F.round("share", 6), "cohesion": F.round("cohesion", 6)})


@query(f"WITH RECURSIVE {STATS} SELECT * FROM st")
def component_stats(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d)


@query(f"WITH RECURSIVE {STATS} SELECT count(*) AS n_clusters, max(size) AS max_size, max(share) AS max_share, count(*) FILTER (is_giant) AS n_giant, CASE WHEN count(*) FILTER (is_giant) = 1 THEN 'one cluster holds over half of the nodes' ELSE '' END AS warning FROM st")
def giant_component(spark: SparkSession, d: str) -> DataFrame:
    n = F.count_if("is_giant")
    return _stats(spark, d).agg(F.count("*").alias("n_clusters"), F.max("size").alias("max_size"), F.max("share").alias("max_share"), n.alias("n_giant"), F.when(n == 1, "one cluster holds over half of the nodes").otherwise("").alias("warning"))


@query(f"""WITH RECURSIVE {COMPONENTS}, dg AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM e UNION ALL SELECT target FROM e) GROUP BY node),
k AS (SELECT c.root, 'DOC-' || c.node AS label, row_number() OVER (PARTITION BY c.root ORDER BY coalesce(degree, 0) DESC, 'DOC-' || c.node) AS n FROM c LEFT JOIN dg ON dg.node = c.node)
SELECT root, string_agg(label, ', ' ORDER BY n) AS label FROM k WHERE n <= 3 GROUP BY root""")
def component_labels(spark: SparkSession, d: str) -> DataFrame:
    members, edges = line_components(spark, d)
    members = cut(members)
    degree = edges.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    degree = members.select("node").join(degree, "node", "left").na.fill(0, ["degree"]).withColumn("label", F.concat(F.lit("DOC-"), F.col("node").cast("string")))
    return g.cluster_labels(members, degree)


_ROUND = "l{1} AS (SELECT node, label FROM (SELECT b.source AS node, l.label, row_number() OVER (PARTITION BY b.source ORDER BY count(*) DESC, l.label) AS n FROM b JOIN l{0} l ON l.node = b.target GROUP BY b.source, l.label) WHERE n = 1)"


@query(f"""WITH t AS ({og.TRADE_SQL}), b AS (SELECT source, target FROM t UNION SELECT target, source FROM t), l0 AS (SELECT DISTINCT source AS node, source AS label FROM b),
{', '.join(_ROUND.format(i, i + 1) for i in range(3))} SELECT node, label FROM l3""")
def label_propagation_rounds(spark: SparkSession, d: str) -> DataFrame:
    return g.propagate_labels(og.trade_edges(spark, d), 3)


#: customers in cliques of thirty by number, joined in a chain by one edge each: modularity is greatest with a community for each clique
CLIQUE = 30


def _cliques(spark: SparkSession, d: str, chained: bool) -> tuple[DataFrame, DataFrame]:
    nodes = og.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    of = nodes.select("id", F.expr(f"id DIV {CLIQUE}").alias("k"))
    inner = of.select(F.col("id").alias("source"), "k").join(of.select(F.col("id").alias("target"), "k"), "k").where("source < target").select("source", "target")
    bridge = nodes.where(F.col("id") % CLIQUE == 0).select((F.col("id") - 1).alias("source"), F.col("id").alias("target"))
    return nodes, cut(g.admit(inner.unionAll(bridge) if chained else inner, nodes))


PLANTED = f"SELECT c_custkey AS node, min(c_custkey) OVER (PARTITION BY c_custkey // {CLIQUE}) AS root FROM customer"


@query(PLANTED)
def communities_planted(spark: SparkSession, d: str) -> DataFrame:
    """By modularity, the first method that is tried."""
    return g.communities(*_cliques(spark, d, True), "auto")[0]


@query(PLANTED)
def labels_planted(spark: SparkSession, d: str) -> DataFrame:
    """By label propagation over the same cliques without the chain: a clique is at rest with one label only."""
    return g.communities(*_cliques(spark, d, False), "label_propagation")[0]


@query(f"""WITH RECURSIVE {COMPONENTS} SELECT node, count(*) AS neighbours, TRUE AS settled, c.root AS component FROM c JOIN b ON b.a = c.node GROUP BY node, c.root""")
def labels_settled(spark: SparkSession, d: str) -> DataFrame:
    """Label propagation over documents with common lines: no label around a node is commoner than its own, and labels stay in their component."""
    edges = line_edges(spark, d)
    labels = g.settle_labels(edges)
    pairs = g.both_ways(edges).where("source <> target").distinct()
    votes = pairs.join(labels.select(F.col("node").alias("target"), "label"), "target").groupBy(F.col("source").alias("node"), "label").agg(F.count("*").alias("n"))
    own = votes.join(labels.withColumnRenamed("label", "own"), "node").groupBy("node").agg(F.sum("n").alias("neighbours"), (F.max(F.when(F.col("label") == F.col("own"), F.col("n"))) == F.max("n")).alias("settled"))
    roots = g.connected(edges.select(F.col("source").alias("src"), F.col("target").alias("dst"))).withColumnRenamed("root", "component")
    # the component of the node that gave the label
    given = labels.join(roots.select(F.col("node").alias("label"), "component"), "label").select("node", "component")
    return own.select("node", "neighbours", F.coalesce("settled", F.lit(False)).alias("settled")).join(given, "node")
