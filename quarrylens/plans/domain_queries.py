"""Text, state, resolution, rule and verification queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens.functions import text as tx
from quarrylens.functions.sqlfacts import access_mode, operation
from quarrylens.operators import graph as g
from quarrylens.operators import model as md
from quarrylens.operators import rules as rl
from quarrylens.operators import verify as vf
from quarrylens.operators.contract import operations
from quarrylens.plans.order_graph import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def redact_sql(c: str) -> str:
    """The redaction chain in SQL."""
    p = tx.PLACEHOLDER
    steps = ((tx.BEARER, f"Bearer {p}"), (tx.KEY_VALUE, rf"\1\2\3\4\5{p}\4\5"), (tx.JDBC, rf"\1;{p}"), (tx.USER_INFO, rf"\1{p}@"))
    for pattern, to in steps:
        c = f"regexp_replace({c}, {_quote(pattern)}, {_quote(to)}, 'g')"
    return c


def _redacted(df: DataFrame, key: str, column: str) -> DataFrame:
    r = df.select(key, F.col(column).alias("raw"), tx.redact(column).alias("safe"))
    count = lambda c: F.regexp_count(c, F.lit(r"\[REDACTED\]"))
    return r.select(key, F.md5("safe").alias("digest"), (count(F.col("safe")) - count(F.col("raw"))).cast("long").alias("n_redacted"), (F.col("safe") != F.col("raw")).alias("changed"))


def _redacted_sql(source: str, key: str, column: str) -> str:
    n = "CAST(len(regexp_extract_all({0}, '\\[REDACTED\\]')) AS BIGINT)"
    return f"SELECT {key}, md5(safe) AS digest, {n.format('safe')} - {n.format('raw')} AS n_redacted, safe <> raw AS changed FROM (SELECT {key}, {column} AS raw, {redact_sql(column)} AS safe FROM {source})"


@query(_redacted_sql("documents", "doc_id", "text"))
def redact_documents(spark: SparkSession, d: str) -> DataFrame:
    return _redacted(table(spark, d, "documents"), "doc_id", "text")


@query(_redacted_sql("pages", "page_id", "html"))
def redact_pages(spark: SparkSession, d: str) -> DataFrame:
    return _redacted(table(spark, d, "pages"), "page_id", "html")


#: what stands before and after a customer's name, which is the secret in most of them
SHAPES = (
    ('dbPassword = "hun ', '"'),
    ("API_TOKEN As String = '", "'"),
    ("Authorization: Bearer abcdefgh", ""),
    ("pwd=", ";next=1"),
    ('{"client_secret": "', ' y"}'),
    ("jdbc:oracle://host:1521/x;password=", " user"),
    ("https://me:", "@host/path"),
    ("If total > limit Then ", ""),
    ("tokenise the ", ""),
    ("conn_str := ", ""),
)


def _inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda x: "NULL" if x is None else _quote(x) if isinstance(x, str) else "[" + ", ".join(map(lit, x)) + "]" if isinstance(x, list) else str(x).upper() if isinstance(x, bool) else str(x)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({names}))"


def _filled(spark: SparkSession, d: str, shapes: tuple, name: F.Column) -> DataFrame:
    """(id, i, text): each shape around something of each customer."""
    made = F.array(*[F.concat(F.lit(a), name, F.lit(b)) for a, b in shapes])
    # a small file is one task, and the work on its texts is not small: a number given here keeps it spread
    rows = table(spark, d, "customer").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    return rows.select(F.col("c_custkey"), F.posexplode(made).alias("i", "text")).select((F.col("c_custkey") * len(shapes) + F.col("i")).alias("id"), "i", "text")


def _filled_sql(shapes: tuple, name: str) -> str:
    return f"(SELECT c_custkey * {len(shapes)} + i AS id, i, a || {name} || b AS text FROM customer, {_values([(i, a, b) for i, (a, b) in enumerate(shapes)], 'i, a, b')})"


@query(f"SELECT id, {redact_sql('text')} AS safe FROM {_filled_sql(SHAPES, 'c_name')}")
def redact_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Every shape of a secret with every customer's name in it."""
    return _filled(spark, d, SHAPES, F.col("c_name")).select("id", tx.redact("text").alias("safe"))


@query(f"""SELECT event_id, {_quote(tx.PLACEHOLDER)} AS token, {redact_sql("event_type || '=' || json_extract_string(props, '$.k')")} AS detail FROM events""")
def redact_props(spark: SparkSession, d: str) -> DataFrame:
    """The properties of events as a map, with a key that names a secret."""
    props = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("api_token"), F.col("user_id").cast("string")))
    m = tx.redact_map(F.transform_values(props, lambda k, v: F.when(k == "k", F.concat("event_type", F.lit("="), v)).otherwise(v)))
    return table(spark, d, "events").select("event_id", m["api_token"].alias("token"), m["k"].alias("detail"))


@query("SELECT doc_id, (length(text) + 3) // 4 AS tokens, greatest(1, length(text) // 4) AS tokens_floor FROM documents")
def token_estimate_docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.expr("CAST((length(text) + 3) DIV 4 AS BIGINT)").alias("tokens"), F.expr("CAST(greatest(1, length(text) DIV 4) AS BIGINT)").alias("tokens_floor"))


@query("""WITH s AS (SELECT lang, CAST(sum((length(text) + 3) // 4) AS BIGINT) AS slice_tokens, count(*) AS n FROM documents GROUP BY lang),
t AS (SELECT sum(slice_tokens) AS total FROM s) SELECT lang, n, slice_tokens, round(slice_tokens / total, 6) AS ratio FROM s, t""")
def context_reduction(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of a part of the corpus against those of all."""
    per = table(spark, d, "documents").groupBy("lang").agg(F.sum(F.expr("(length(text) + 3) DIV 4")).cast("long").alias("slice_tokens"), F.count("*").alias("n"))
    total = F.sum("slice_tokens").over(Window.partitionBy(F.lit(0)))
    return per.select("lang", "n", "slice_tokens", F.round(F.col("slice_tokens") / total, 6).alias("ratio"))


_SLUG = "coalesce(nullif(regexp_replace(substr(upper(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), 1, 60), '_+$', ''), ''), 'UNNAMED')"


def slug_sql(c: str) -> str:
    """The identifier of a column in SQL; UNNAMED for null too."""
    return _SLUG.format(c)


@query(f"SELECT 'part' AS kind, p_partkey AS key, {_SLUG.format('p_name')} AS slug FROM part UNION ALL SELECT 'customer', c_custkey, {_SLUG.format('c_name')} FROM customer UNION ALL SELECT 'page', page_id, {_SLUG.format('url')} FROM pages")
def slug_ids(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, kind, key, name: table(spark, d, t).select(F.lit(kind).alias("kind"), F.col(key).alias("key"), tx.slug(name).alias("slug"))
    return one("part", "part", "p_partkey", "p_name").unionAll(one("customer", "customer", "c_custkey", "c_name")).unionAll(one("pages", "page", "page_id", "url"))


@query("SELECT doc_id, sha256(text) AS digest, substr(sha256(text), 1, 16) AS fingerprint, 'SQL-' || doc_id || '-' || substr(sha256(text), 1, 8) AS sql_id FROM documents")
def content_digest(spark: SparkSession, d: str) -> DataFrame:
    digest = F.sha2("text", 256)
    return table(spark, d, "documents").select("doc_id", digest.alias("digest"), F.substring(digest, 1, 16).alias("fingerprint"), F.concat_ws("-", F.lit("SQL"), F.col("doc_id").cast("string"), F.substring(digest, 1, 8)).alias("sql_id"))


@query("SELECT from_state, to_state, trigger, first_event FROM (SELECT 'UNKNOWN' AS from_state, event_type AS to_state, 'user-' || user_id AS trigger, event_id AS first_event, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def state_transitions_observed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.lit("UNKNOWN").alias("from_state"), F.col("event_type").alias("to_state"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("trigger"), "ts", F.col("event_id").alias("first_event"))
    return g.keep_first(e, ["to_state", "trigger"], "ts", "first_event").drop("ts")


INFERRED = "SELECT user_id, event_id, event_type AS from_state, lead(event_type) OVER w AS to_state FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


@query(f"SELECT user_id, event_id, from_state, to_state FROM ({INFERRED}) WHERE to_state <> from_state")
def state_transitions_inferred(spark: SparkSession, d: str) -> DataFrame:
    return md.inferred_transitions(table(spark, d, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("value")), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "from_state", "to_state")


@query(f"SELECT DISTINCT name FROM (SELECT from_state AS name FROM ({INFERRED}) UNION ALL SELECT to_state FROM ({INFERRED}) UNION ALL SELECT 'UNKNOWN') WHERE name <> 'UNKNOWN'")
def state_names(spark: SparkSession, d: str) -> DataFrame:
    return md.state_names(state_transitions_inferred(spark, d).select("from_state", "to_state").unionAll(state_transitions_observed(spark, d).select("from_state", "to_state")))


@query("""SELECT event_id, coalesce(first_value(kind IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING), 'branch') AS outcome
FROM (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN NULL WHEN event_type = 'error' THEN 'reject' ELSE 'branch' END AS kind FROM events)""")
def outcome_lookahead(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("view", "click"), F.lit(None)).when(F.col("event_type") == "error", F.lit("reject")).otherwise(F.lit("branch"))
    return table(spark, d, "events").select("event_id", rl.outcome_ahead(kind, ["user_id"], ["ts", "event_id"]).alias("outcome"))


@query("""WITH p AS (SELECT lower(name) AS name, count(*) AS n, min(id) AS id FROM (SELECT c_name AS name, 'CUST-' || c_custkey AS id FROM customer UNION ALL SELECT p_brand, 'PART-' || p_partkey FROM part) GROUP BY 1),
c AS (SELECT o_orderkey AS call_id, CASE o_orderkey % 3 WHEN 0 THEN upper(c_name) WHEN 1 THEN 'brand#' || (o_orderkey % 30) ELSE 'Missing' || o_orderkey END AS callee, CASE WHEN o_orderkey % 7 = 0 THEN 'EXTERNAL' ELSE 'STATIC' END AS kind FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT call_id, callee, CASE WHEN kind <> 'EXTERNAL' AND n = 1 THEN id END AS callee_id, CASE WHEN kind <> 'EXTERNAL' AND n > 1 THEN 'UNRESOLVED' ELSE kind END AS kind, CASE WHEN kind = 'EXTERNAL' THEN 0 ELSE coalesce(n, 0) END AS candidates FROM c LEFT JOIN p ON lower(callee) = p.name""")
def name_resolution(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer")
    k = F.col("o_orderkey")
    callee = F.when(k % 3 == 0, F.upper("c_name")).when(k % 3 == 1, F.concat(F.lit("brand#"), (k % 30).cast("string"))).otherwise(F.concat(F.lit("Missing"), k.cast("string")))
    calls = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(k.alias("call_id"), callee.alias("callee"), F.when(k % 7 == 0, "EXTERNAL").otherwise("STATIC").alias("kind"))
    procs = c.select(F.concat(F.lit("CUST-"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"))
    procs = procs.unionAll(table(spark, d, "part").select(F.concat(F.lit("PART-"), F.col("p_partkey").cast("string")), "p_brand"))
    return md.resolve_calls(calls, procs)


@query("""SELECT l_suppkey AS object_id, count(*) AS n_seen, arg_min('PART-' || l_partkey, struct_pack(a := l_shipdate, b := l_orderkey, c := l_linenumber, e := l_partkey)) AS first_seen,
CASE WHEN bool_or(l_returnflag = 'R') THEN 'OK' ELSE 'PARTIAL' END AS status, array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS refs FROM lineitem GROUP BY l_suppkey""")
def object_merge(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("object_id"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").alias("order"), F.concat(F.lit("PART-"), F.col("l_partkey").cast("string")).alias("seen_in"), (F.col("l_returnflag") == "R").alias("proven"), F.col("l_linestatus").alias("ref"))
    return md.merge_objects(seen).select("object_id", "n_seen", "first_seen", "status", F.array_join("refs", ",").alias("refs"))


@query("""WITH dec AS (SELECT c_name || CASE WHEN c_custkey % 2 = 0 THEN '.frm' ELSE '' END AS declared FROM customer), re AS (SELECT c_name AS name FROM customer WHERE c_custkey % 5 <> 0)
SELECT declared, name AS component, name IS NULL AS orphan FROM dec LEFT JOIN re ON lower(regexp_replace(declared, '(?i)[.]frm$', '')) = lower(name)""")
def declaration_fold(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    declared = c.select(F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, ".frm").otherwise("")).alias("declared"))
    return md.fold_declarations(declared, c.where("c_custkey % 5 <> 0").select(F.col("c_name").alias("name")))


#: what stands before and after the name of a table
STATEMENTS = (
    ("SELECT a FROM ", ""),
    ("insert into ", " values (1)"),
    ("  Update ", " SET a = 1"),
    ("DELETE FROM ", ""),
    ("MERGE INTO ", " USING s ON 1 = 1"),
    ("create table ", " (a int)"),
    ("ALTER TABLE ", " ADD b int"),
    ("DROP TABLE ", ""),
    ("truncate table ", ""),
    ("{call pkg.", "(?, ?)}"),
    ("call ", "(1)"),
    ("GRANT x TO ", ""),
    ("-- ", ""),
    ("WITH a AS (SELECT 1 FROM ", ") SELECT * FROM a"),
    ("-- note\nDELETE FROM ", ""),
    ("/* note */ WITH x AS (SELECT 1) INSERT INTO ", " SELECT * FROM x"),
)
#: by hand
OPERATIONS = ("SELECT", "INSERT", "UPDATE", "DELETE", "MERGE", "CREATE", "ALTER", "DROP", "TRUNCATE", "CALL", "CALL", "UNKNOWN", "UNKNOWN", "SELECT", "DELETE", "INSERT")


@query(f"""SELECT id, operation, CASE WHEN operation = 'SELECT' THEN 'READ' WHEN operation IN ('UNKNOWN', 'CALL') THEN 'UNKNOWN' ELSE 'WRITE' END AS access_mode
FROM {_filled_sql(STATEMENTS, "'T' || c_custkey")} JOIN {_values([*enumerate(OPERATIONS)], 'i, operation')} o USING (i)""")
def sql_access_mode(spark: SparkSession, d: str) -> DataFrame:
    """Every kind of statement on a table for every customer."""
    s = _filled(spark, d, STATEMENTS, F.concat(F.lit("T"), F.col("c_custkey").cast("string"))).withColumn("operation", operation("text"))
    return s.select("id", "operation", access_mode(F.col("operation")).alias("access_mode"))


#: rule_id, flow, expression, behaviour
RULES = [
    ("RULE-A-001", "A", "balance < 0", "reject"),
    ("RULE-A-002", "A", "balance >= limit", "accept"),
    ("RULE-A-003", "A", 'segment = "BUILDING"', "unknown"),
    ("RULE-B-001", "B", "nation <> 7", "transition"),
    ("RULE-B-002", "B", "Validation.IsValid(nation)", "reject"),
    ("RULE-C-001", None, "segment > other", "accept"),
]
INPUTS = {"balance": "CAST(floor(c_acctbal) AS BIGINT)", "limit": "5000", "segment": "c_mktsegment", "nation": "c_nationkey"}


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """A case for each customer; a third belongs to flow A, a third to flow B."""
    k = F.col("c_custkey")
    m = F.create_map(*[x for n, e in INPUTS.items() for x in (F.lit(n), F.expr(e).cast("string"))])
    return table(spark, d, "customer").select(k.alias("case_id"), F.when(k % 3 == 0, "A").when(k % 3 == 1, "B").alias("flow_id"), m.alias("inputs"))


def _rules(spark: SparkSession) -> DataFrame:
    return _inline(spark, RULES, "rule_id string, flow_id string, expression string, behavior_type string")


SIMULATED = """c AS (SELECT c_custkey AS case_id, CASE c_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS flow, CAST(floor(c_acctbal) AS BIGINT) AS b, c_mktsegment AS s, c_nationkey AS n FROM customer),
sim AS (
  SELECT case_id, 'RULE-A-001' AS rule_id, CASE WHEN b < 0 THEN 'reject' ELSE 'not_fired' END AS got FROM c WHERE flow IS NULL OR flow = 'A'
  UNION ALL SELECT case_id, 'RULE-A-002', CASE WHEN b >= 5000 THEN 'accept' ELSE 'not_fired' END FROM c WHERE flow IS NULL OR flow = 'A'
  UNION ALL SELECT case_id, 'RULE-A-003', CASE WHEN s = 'BUILDING' THEN 'fired' ELSE 'not_fired' END FROM c WHERE flow IS NULL OR flow = 'A'
  UNION ALL SELECT case_id, 'RULE-B-001', CASE WHEN n <> 7 THEN 'transition' ELSE 'not_fired' END FROM c WHERE flow IS NULL OR flow = 'B'
  UNION ALL SELECT case_id, 'RULE-B-002', 'unknown' FROM c WHERE flow IS NULL OR flow = 'B'
  UNION ALL SELECT case_id, 'RULE-C-001', 'unknown' FROM c)"""


@query(f"WITH {SIMULATED} SELECT * FROM sim")
def rule_simulate(spark: SparkSession, d: str) -> DataFrame:
    return rl.simulate(_cases(spark, d), _rules(spark))


# what the old system is known to have answered: A-001 right but for few, B-001 always transition, C-001 not known, A-009 not in the new system
EXPECTED = """x AS (
  SELECT case_id, 'RULE-A-001' AS key, CASE WHEN b < 0 OR case_id % 10 = 0 THEN 'reject' ELSE 'not_fired' END AS want FROM c WHERE flow = 'A'
  UNION ALL SELECT case_id, 'RULE-B-001', 'transition' FROM c WHERE flow = 'B'
  UNION ALL SELECT case_id, 'RULE-C-001', 'unknown' FROM c WHERE flow IS NULL
  UNION ALL SELECT case_id, 'RULE-C-001', 'accept' FROM c WHERE flow = 'A' AND case_id % 4 = 0
  UNION ALL SELECT case_id, 'RULE-A-009', 'accept' FROM c WHERE flow = 'A' AND case_id % 25 = 0)"""
COMPARED = f"""{SIMULATED}, {EXPECTED}, cmp AS (
  SELECT x.case_id, key, want, got, CASE WHEN got IS NULL THEN 'divergence' WHEN want = 'unknown' OR got = 'unknown' THEN 'undecidable' WHEN got = want THEN 'match' ELSE 'divergence' END AS outcome,
    CASE WHEN got IS NULL THEN key || ': absent from the new system (expected ' || want || ')' WHEN want = 'unknown' THEN key || ': expectation is itself unknown'
      WHEN got = 'unknown' THEN key || ': the new system cannot evaluate this rule (expected ' || want || '); it needs a real run or a better rule'
      WHEN got = want THEN key ELSE key || ': expected ' || want || ', got ' || got END AS detail
  FROM x LEFT JOIN sim ON sim.case_id = x.case_id AND sim.rule_id = x.key)"""
RESULTS = f"""{COMPARED}, res AS (SELECT case_id, count(*) FILTER (outcome = 'match') AS n_match, count(*) FILTER (outcome = 'divergence') AS n_divergence, count(*) FILTER (outcome = 'undecidable') AS n_undecidable FROM cmp GROUP BY case_id),
st AS (SELECT *, CASE WHEN n_match = 0 AND n_divergence = 0 AND n_undecidable > 0 THEN 'SKIPPED' WHEN n_divergence > 0 THEN 'FAILED' ELSE 'PASSED' END AS status FROM res)"""
RECORDS = f"""{RESULTS}, dv AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY key) AS i FROM cmp WHERE outcome = 'divergence'),
rec AS (SELECT 'DIV-' || case_id || '-' || printf('%02d', i) AS divergence_id, case_id, key AS rule_id, CASE WHEN got IS NULL THEN 'MISSING_IN_NEW' ELSE 'REQUIRES_REVIEW' END AS status,
  detail AS summary, want AS legacy, got AS new_system, CASE WHEN key = 'RULE-A-001' THEN 'rules.bas:12' ELSE 'manual observation' END AS source, case_id % 50 <> 0 AS blocking FROM dv)"""


def _expected(spark: SparkSession, d: str) -> DataFrame:
    c = _cases(spark, d)
    k, b = F.col("case_id"), F.col("inputs")["balance"].cast("long")
    one = lambda where, key, want: c.where(where).select("case_id", F.lit(key).alias("key"), want.alias("want"))
    parts = (
        one("flow_id = 'A'", "RULE-A-001", F.when((b < 0) | (k % 10 == 0), "reject").otherwise("not_fired")),
        one("flow_id = 'B'", "RULE-B-001", F.lit("transition")),
        one("flow_id IS NULL", "RULE-C-001", F.lit("unknown")),
        one("flow_id = 'A' AND case_id % 4 = 0", "RULE-C-001", F.lit("accept")),
        one("flow_id = 'A' AND case_id % 25 = 0", "RULE-A-009", F.lit("accept")),
    )
    return g.union(*parts)


def _compared(spark: SparkSession, d: str) -> DataFrame:
    return vf.compare_rules(_expected(spark, d), rule_simulate(spark, d).withColumnRenamed("rule_id", "key"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    cases = _cases(spark, d).select("case_id", "flow_id", F.when(F.col("case_id") % 50 == 0, "low").otherwise("high").alias("confidence"), F.lit(None).cast("string").alias("captured_from"), F.lit("manual observation").alias("evidence"))
    return vf.divergence_records(_compared(spark, d), cases, _inline(spark, [("RULE-A-001", "rules.bas", 12)], "rule_id string, file string, line int"))


@query(f"WITH {RESULTS} SELECT * FROM st")
def golden_compare(spark: SparkSession, d: str) -> DataFrame:
    return vf.case_status(_compared(spark, d))


@query("""WITH x AS (SELECT o_orderkey AS case_id, unnest(['status', 'priority', 'customer']) AS key, unnest([o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR)]) AS want FROM orders),
a AS (SELECT o_orderkey AS case_id, unnest(['status', 'priority', 'extra']) AS key, unnest([o_orderstatus, CASE WHEN o_orderkey % 10 = 0 THEN '1-URGENT' ELSE o_orderpriority END, CASE WHEN o_orderkey % 2 = 0 THEN 'more' END]) AS got FROM orders), b AS (SELECT * FROM a WHERE got IS NOT NULL)
SELECT coalesce(x.case_id, b.case_id) AS case_id, coalesce(x.key, b.key) AS key, CASE WHEN want = got THEN 'match' ELSE 'divergence' END AS outcome,
CASE WHEN got IS NULL THEN x.key || ': missing in the new system (expected ' || want || ')' WHEN want IS NULL THEN b.key || ': unexpected in the new system (' || got || ')' WHEN want = got THEN x.key ELSE x.key || ': expected ' || want || ', got ' || got END AS detail
FROM x FULL JOIN b ON x.case_id = b.case_id AND x.key = b.key""")
def golden_payload_compare(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    rows = lambda m, name: o.select(k.alias("case_id"), F.explode(m).alias("key", name))
    want = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"), F.lit("customer"), F.col("o_custkey").cast("string"))
    got = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.when(k % 10 == 0, "1-URGENT").otherwise(F.col("o_orderpriority")), F.lit("extra"), F.when(k % 2 == 0, "more"))
    return vf.compare_payload(rows(want, "want"), rows(F.map_filter(got, lambda _, v: v.isNotNull()), "got")).select("case_id", "key", "outcome", "detail")


@query(f"WITH {RECORDS} SELECT * FROM rec")
def divergences(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d)


@query(f"WITH {RECORDS} SELECT status, count(*) AS n, count(*) FILTER (blocking) AS n_blocking FROM rec GROUP BY status")
def divergence_summary(spark: SparkSession, d: str) -> DataFrame:
    return vf.summary(_records(spark, d))


@query(f"""WITH {RECORDS}, t AS (SELECT count(*) FILTER (status = 'PASSED') AS passed, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'SKIPPED') AS skipped FROM st), b AS (SELECT count(*) FILTER (blocking) AS blocking FROM rec)
SELECT passed, failed, skipped, blocking, failed = 0 AND blocking = 0 AS ok_strict, blocking = 0 AS ok_blocking FROM t, b""")
def verify_totals(spark: SparkSession, d: str) -> DataFrame:
    return vf.totals(golden_compare(spark, d), _records(spark, d))


CANDIDATES = """k AS (SELECT replace(p_brand, '#', '') AS flow, p_partkey AS seq, CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_name END AS name, list_filter(['size ' || p_size, CASE WHEN p_partkey % 2 = 0 THEN 'type ' || p_type END, CASE WHEN p_partkey % 11 = 0 THEN ' ' END], lambda x: x IS NOT NULL AND p_partkey % 13 <> 0) AS observation, CASE WHEN p_partkey % 3 = 0 THEN ['guess'] ELSE CAST([] AS VARCHAR[]) END AS inference FROM part),
o AS (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY lower(name), coalesce(observation[1], ''), seq) AS ordinal FROM k),
a AS (SELECT 'RULE-' || flow || '-' || printf('%03d', ordinal) AS rule_id, flow, seq, ordinal, trim(name) AS name, len(list_filter(observation, lambda x: trim(x) <> '')) AS n_obs, len(inference) AS n_inf FROM o),
r AS (SELECT *, CASE WHEN name = '' THEN 'candidate has no name' WHEN n_obs < 1 THEN 'no observation to point at' END AS reason FROM a)"""


def _admitted(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    obs = F.array_compact(F.array(F.concat(F.lit("size "), F.col("p_size").cast("string")), F.when(k % 2 == 0, F.concat(F.lit("type "), F.col("p_type"))), F.when(k % 11 == 0, F.lit(" "))))
    c = table(spark, d, "part").select(
        F.replace("p_brand", F.lit("#"), F.lit("")).alias("flow"),
        k.alias("seq"),
        F.when(k % 7 == 0, " ").otherwise(F.col("p_name")).alias("name"),
        F.when(k % 13 != 0, obs).otherwise(F.array().cast("array<string>")).alias("observation"),
        F.when(k % 3 == 0, F.array(F.lit("guess"))).otherwise(F.array().cast("array<string>")).alias("inference"),
    )
    return rl.admit(c)


@query(f"WITH {CANDIDATES} SELECT rule_id, flow, ordinal, name, CASE WHEN n_obs >= 2 AND n_inf = 0 THEN 'high' ELSE 'medium' END AS confidence, 'candidate' AS status FROM r WHERE reason IS NULL")
def rule_admission(spark: SparkSession, d: str) -> DataFrame:
    return _admitted(spark, d).where("reason IS NULL").select("rule_id", "flow", "ordinal", "name", "confidence", "status")


@query(f"WITH {CANDIDATES} SELECT flow, seq, ordinal, reason FROM r WHERE reason IS NOT NULL")
def rule_rejections(spark: SparkSession, d: str) -> DataFrame:
    return _admitted(spark, d).where("reason IS NOT NULL").select("flow", "seq", "ordinal", "reason")


def _old_catalog(spark: SparkSession, d: str) -> DataFrame:
    return rule_admission(spark, d).where("ordinal % 3 = 0").withColumn("name", F.concat(F.lit("kept "), F.col("name")))


@query(f"WITH {CANDIDATES} SELECT rule_id, flow, ordinal, CASE WHEN ordinal % 3 = 0 THEN 'kept ' || name ELSE name END AS name, CASE WHEN n_obs >= 2 AND n_inf = 0 THEN 'high' ELSE 'medium' END AS confidence, 'candidate' AS status FROM r WHERE reason IS NULL")
def catalog_insert_absent(spark: SparkSession, d: str) -> DataFrame:
    return rl.insert_absent(_old_catalog(spark, d), rule_admission(spark, d))


REVIEWED = f"""{CANDIDATES}, v AS (SELECT rule_id, flow, ordinal, name, n_obs, CASE WHEN ordinal % 2 = 0 THEN 'validated' WHEN ordinal % 5 = 0 THEN 'rejected' ELSE 'candidate' END AS status,
  CASE WHEN ordinal % 2 = 0 OR (n_obs >= 2 AND n_inf = 0) THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN ordinal % 2 = 0 OR ordinal % 5 = 0 THEN 'ana' END AS reviewed_by FROM r WHERE reason IS NULL)"""


def _reviewed(spark: SparkSession, d: str) -> DataFrame:
    """Even ordinals are rejected first and approved later, others with a factor of five rejected, and one in seven reset before that."""
    cat = rule_admission(spark, d)
    act = lambda where, decision, who, at: cat.where(where).select("rule_id", F.lit(decision).alias("decision"), F.lit(who).alias("reviewer"), F.lit(at).alias("at"), F.lit("seen").alias("note"))
    decisions = g.union(act("ordinal % 7 = 0", "reset", "", 1), act("ordinal % 2 = 0", "reject", "bob", 2), act("ordinal % 2 = 0", "approve", "ana", 3), act("ordinal % 2 <> 0 AND ordinal % 5 = 0", "reject", "ana", 4))
    return rl.review(cat, decisions, strict=False)


@query(f"WITH {REVIEWED} SELECT rule_id, status, confidence, reviewed_by FROM v")
def review_transition(spark: SparkSession, d: str) -> DataFrame:
    return _reviewed(spark, d).select("rule_id", "status", "confidence", "reviewed_by")


@query(f"""WITH {REVIEWED}, w AS (SELECT *, array_to_string(list_transform(string_split(name, ' '), lambda x: upper(x[1]) || substr(x, 2)), '') AS big FROM v WHERE status = 'validated'),
b AS (SELECT *, lower(big[1]) || substr(big, 2) AS base FROM w), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY rule_id) AS i FROM b)
SELECT rule_id, base || CASE WHEN i > 1 THEN CAST(i AS VARCHAR) ELSE '' END AS operation_id, '/' || CASE WHEN flow LIKE '%1%' THEN 'form' ELSE 'rules' END || '/' || base || CASE WHEN i > 1 THEN CAST(i AS VARCHAR) ELSE '' END AS path, CASE WHEN flow LIKE '%1%' THEN 'form' ELSE 'rules' END AS entry_group FROM n""")
def contract_operations(spark: SparkSession, d: str) -> DataFrame:
    rules = _reviewed(spark, d).withColumn("entry_point_id", F.concat(F.lit("ENTRY-"), F.col("flow")))
    entries = table(spark, d, "part").select(F.replace("p_brand", F.lit("#"), F.lit("")).alias("flow")).distinct().where("flow LIKE '%1%'").select(F.concat(F.lit("ENTRY-"), F.col("flow")).alias("entry_point_id"), F.lit("FORM").alias("kind"))
    return operations(rules, entries).select("rule_id", "operation_id", "path", "entry_group")


@query("""WITH x AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), m AS (SELECT item_id, min(doc_id) AS doc_id, count(*) AS n_docs FROM x GROUP BY item_id)
SELECT b.item_id, coalesce(m.doc_id, (SELECT min(doc_id) FROM documents)) AS doc_id, m.doc_id IS NOT NULL AS attributed, coalesce(n_docs, 0) AS n_docs FROM benchmark b LEFT JOIN m USING (item_id)""")
def evidence_attribution(spark: SparkSession, d: str) -> DataFrame:
    """The first document that holds each passage, else the first document."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return md.attribute(table(spark, d, "benchmark").select("item_id", F.col("text").alias("needle")), docs, "item_id", "doc_id")


@query("""WITH f AS (SELECT item_id, split_part(text, ' ', 1) AS a, split_part(text, ' ', 2) AS b, text FROM benchmark),
k AS (SELECT item_id * 5 AS id, a AS needle FROM f UNION ALL SELECT item_id * 5 + 1, a || ' ' || b FROM f UNION ALL SELECT item_id * 5 + 2, substr(text, 3, 7) FROM f UNION ALL SELECT item_id * 5 + 3, substr(text, 2, 2) FROM f UNION ALL SELECT item_id * 5 + 4, substr(text, length(text) - 3, 5) FROM f),
x AS (SELECT id, doc_id FROM k JOIN documents d ON contains(d.text, needle)), m AS (SELECT id, min(doc_id) AS doc_id, count(*) AS n_docs FROM x GROUP BY id)
SELECT k.id, coalesce(m.doc_id, (SELECT min(doc_id) FROM documents)) AS doc_id, m.doc_id IS NOT NULL AS attributed, coalesce(n_docs, 0) AS n_docs FROM k LEFT JOIN m USING (id)""")
def short_evidence_attribution(spark: SparkSession, d: str) -> DataFrame:
    """The same for short needles: first words of passages, pieces that begin and end within words, their last characters."""
    b, words = table(spark, d, "benchmark"), F.split("text", " ")
    first, second = words[0], F.coalesce(F.get(words, F.lit(1)), F.lit(""))
    parts = (first, F.concat(first, F.lit(" "), second), F.substring("text", 3, 7), F.substring("text", 2, 2), F.substring(F.col("text"), F.length("text") - 3, F.lit(5)))
    needles = b.select("item_id", F.posexplode(F.array(*parts)).alias("j", "needle")).select((F.col("item_id") * 5 + F.col("j")).alias("id"), "needle")
    return md.attribute(needles, table(spark, d, "documents").select("doc_id", "text"), "id", "doc_id")


@query("""SELECT metric, value FROM (SELECT CAST(count(*) AS DOUBLE) AS documents, CAST(count(DISTINCT source) AS DOUBLE) AS sources, CAST(max(length(text)) AS DOUBLE) AS longest, CAST(sum(length(text)) AS DOUBLE) AS characters, round(avg(CASE WHEN lang = 'en' THEN 1 ELSE 0 END), 6) AS english_share FROM documents)
UNPIVOT (value FOR metric IN (documents, sources, longest, characters, english_share))""")
def report_metrics(spark: SparkSession, d: str) -> DataFrame:
    dbl = lambda c: c.cast("double")
    one = table(spark, d, "documents").agg(dbl(F.count("*")).alias("documents"), dbl(F.countDistinct("source")).alias("sources"), dbl(F.max(F.length("text"))).alias("longest"), dbl(F.sum(F.length("text"))).alias("characters"), F.round(F.avg((F.col("lang") == "en").cast("int")), 6).alias("english_share"))
    return one.unpivot([], ["documents", "sources", "longest", "characters", "english_share"], "metric", "value")


@query("SELECT event_type AS stage, count(*) AS n, count(*) FILTER (value > 100) AS n_slow, count(DISTINCT user_id) AS n_runs FROM events GROUP BY event_type")
def runlog_stage_stats(spark: SparkSession, d: str) -> DataFrame:
    """Events as run-log lines of JSON, parsed and counted by stage."""
    from quarrylens.streaming.runlog import parse, stage_stats

    line = F.to_json(F.struct(F.col("event_type").alias("stage"), F.concat(F.lit("EXEC-"), F.col("user_id").cast("string")).alias("execution_id"), F.col("value").alias("duration_ms"), F.col("ts").cast("string").alias("timestamp")))
    return stage_stats(parse(table(spark, d, "events").select(line.alias("value"))), slow_ms=100.0)


#: the old system's states of a user, and the new one's: some are lost, some take another name
TRACES = """ev AS (SELECT user_id, event_type AS s, event_id, ts, CASE WHEN event_id % 11 = 0 THEN 'click' ELSE event_type END AS t FROM events),
tr AS (SELECT user_id AS case_id, list(s ORDER BY ts, event_id) AS a, coalesce(list(t ORDER BY ts, event_id) FILTER (event_id % 29 <> 0 AND user_id % 3 <> 0 OR user_id % 4 = 0), []) AS b FROM ev WHERE user_id % 10 <> 9 OR event_id % 2 = 0 GROUP BY user_id)"""


@query(f"""WITH RECURSIVE {TRACES}, lcs(case_id, i, r) AS (
  SELECT case_id, 0, list_transform(range(len(b) + 1), lambda x: 0) FROM tr
  UNION ALL SELECT case_id, i + 1, list_transform(range(1, len(b) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN k > 1 AND b[k - 1] = a[i + 1] THEN r[k - 1] + 1 ELSE r[k] END))) FROM lcs JOIN tr USING (case_id) WHERE i < len(a)),
w AS (SELECT case_id, CAST(list_max(r) AS INTEGER) AS n_common FROM lcs JOIN tr USING (case_id) WHERE i = len(a)),
f AS (SELECT case_id, list_min(list_filter(range(greatest(len(a), len(b))), lambda i: a[i + 1] IS DISTINCT FROM b[i + 1])) AS first FROM tr)
SELECT case_id, n_common, CAST(first AS INTEGER) AS first, CASE WHEN first IS NULL THEN 'match' ELSE 'divergence' END AS outcome,
  'state_trace' || CASE WHEN first IS NULL THEN '' ELSE ': at ' || first || ' expected ' || coalesce(a[first + 1], 'the end') || ', got ' || coalesce(b[first + 1], 'the end') || '; ' || n_common || ' of ' || len(a) || ' states in order' END AS detail
FROM tr JOIN w USING (case_id) JOIN f USING (case_id)""")
def state_trace_compare(spark: SparkSession, d: str) -> DataFrame:
    """The states of each user in the old and in the new system."""
    e, mine = table(spark, d, "events"), F.col("user_id")
    e = e.where((mine % 10 != 9) | (F.col("event_id") % 2 == 0))
    kept = ((F.col("event_id") % 29 != 0) & (mine % 3 != 0)) | (mine % 4 == 0)
    order = lambda v: F.transform(F.array_sort(F.collect_list(v)), lambda x: x["s"])
    new = F.when(F.col("event_id") % 11 == 0, "click").otherwise(F.col("event_type"))
    per = e.groupBy(mine.alias("case_id")).agg(order(F.struct("ts", "event_id", F.col("event_type").alias("s"))).alias("a"), order(F.when(kept, F.struct("ts", "event_id", new.alias("s")))).alias("b"))
    return vf.compare_traces(per.select("case_id", F.col("a").alias("trace")), per.select("case_id", F.col("b").alias("trace"))).select("case_id", "n_common", "first", "outcome", "detail")


#: nations are components with a procedure for each segment of their customers; suppliers are variables, of which every third is declared with its nation
TYPED = """pr AS (SELECT DISTINCT 'PROC-' || c_nationkey || '-' || c_mktsegment AS id, n_name AS component, c_mktsegment AS name FROM customer JOIN nation ON n_nationkey = c_nationkey),
ln AS (SELECT l_orderkey, l_suppkey AS v, lead(l_suppkey) OVER w AS nxt, row_number() OVER w AS i FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey)),
asg AS (SELECT DISTINCT v, nxt AS source FROM ln WHERE l_orderkey % 97 = 0 AND v % 3 <> 0 AND nxt IS NOT NULL),
cl AS (SELECT o_orderkey AS call_id, lower(c_mktsegment) AS callee, v, CASE WHEN o_orderkey % 7 = 0 THEN 'EXTERNAL' ELSE 'DYNAMIC' END AS kind FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN ln ON l_orderkey = o_orderkey AND i = 1)"""


@query(f"""WITH RECURSIVE {TYPED}, t(v, type) AS (SELECT s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 3 = 0 UNION SELECT asg.v, t.type FROM t JOIN asg ON asg.source = t.v),
y AS (SELECT call_id, count(DISTINCT id) AS n, min(id) AS id FROM cl JOIN t USING (v) JOIN pr ON component = type AND lower(name) = callee WHERE kind <> 'EXTERNAL' GROUP BY call_id),
z AS (SELECT lower(name) AS callee, count(*) AS n, min(id) AS id FROM pr GROUP BY 1)
SELECT cl.call_id, CASE WHEN y.n = 1 THEN y.id WHEN y.n IS NULL AND kind <> 'EXTERNAL' AND z.n = 1 THEN z.id END AS callee_id,
  CASE WHEN kind = 'EXTERNAL' THEN kind WHEN y.n = 1 THEN 'TYPED' WHEN y.n > 1 OR z.n > 1 THEN 'UNRESOLVED' ELSE kind END AS kind, CASE WHEN kind = 'EXTERNAL' THEN 0 ELSE coalesce(y.n, z.n, 0) END AS candidates
FROM cl LEFT JOIN y USING (call_id) LEFT JOIN z USING (callee)""")
def typed_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Calls of names that many components share, told apart by what their receivers are declared as or were assigned."""
    t = lambda n: table(spark, d, n)
    procedures = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws("-", F.lit("PROC"), F.col("c_nationkey").cast("string"), "c_mktsegment").alias("id"), F.col("n_name").alias("component"), F.col("c_mktsegment").alias("name")).distinct()
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")
    lines = t("lineitem").select("l_orderkey", F.col("l_suppkey").alias("var"), F.lead("l_suppkey").over(w).alias("source"), F.row_number().over(w).alias("i"))
    assigned = lines.where("l_orderkey % 97 = 0 AND var % 3 <> 0 AND source IS NOT NULL")
    declared = t("supplier").where("s_suppkey % 3 = 0").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("var"), F.col("n_name").alias("type"))
    first = lines.where("i = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.col("var").alias("receiver"))
    calls = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(first, "o_orderkey", "left")
    calls = calls.select(F.col("o_orderkey").alias("call_id"), F.lower("c_mktsegment").alias("callee"), "receiver", F.when(F.col("o_orderkey") % 7 == 0, "EXTERNAL").otherwise("DYNAMIC").alias("kind"))
    return md.resolve_typed(calls, procedures, md.infer_types(declared, assigned.select("var", "source"))).select("call_id", "callee_id", "kind", "candidates")
