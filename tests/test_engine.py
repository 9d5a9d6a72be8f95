import xml.etree.ElementTree as ET

import pytest
import yaml
from pyspark.sql import functions as F

from quarrylens import cli
from quarrylens.facade import Engine, NotAvailable
from quarrylens.functions.sqlfacts import analyse
from quarrylens.functions.text import redact_json, slug, slug_text, slug_unicode
from quarrylens.operators import graph as g
from quarrylens.operators import rules as rl
from quarrylens.operators.contract import ContractError
from quarrylens.operators.system import EntryNotFound, resolve_entry
from sample import FILES
from quarrylens.sources import catalogs
from quarrylens.sources.vb6 import LexError, read_file, split_statements, tokenize
from quarrylens.streaming import runlog


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("home")
    src = tmp_path_factory.mktemp("src")
    for name, text in FILES.items():
        p = src / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(text.encode("cp1252"))
    e = Engine(spark, "shop", str(home))
    e.analyse(f"file://{src}")
    e.src = src
    return e


def test_scanner():
    ts = tokenize('Rem note\nx = "a""b" & _\n  &HFF \' end\nAttribute VB_Name = "M"\n10 If a <= 2.5 Then')
    assert [(t.kind, t.value, t.line) for t in ts if t.kind != "NEWLINE"][:6] == [("COMMENT", "Rem note", 1), ("IDENTIFIER", "x", 2), ("OPERATOR", "=", 2), ("STRING", '"a""b"', 2), ("OPERATOR", "&", 2), ("NUMBER", "&HFF", 3)]
    assert ("ATTRIBUTE", 'Attribute VB_Name = "M"') in [(t.kind, t.value) for t in ts]
    with pytest.raises(LexError):
        tokenize('x = "open\n')
    s = split_statements("a = 1  \nb = 2 _\n + 3\n", tokenize("a = 1  \nb = 2 _\n + 3\n"))
    assert [(x.line, x.end_line) for x in s] == [(1, 1), (2, 3)]


def test_reading_of_statements():
    rows = list(read_file("m.bas", 'Function F(ByVal a As Long, Optional P_OUT As String, x) As Boolean\n  estado = "CRIADO"\n  Foo.Bar 1, G(2, 3)\n  Set o = New Thing\nEnd Function\n'))
    proc = next(x for e, x in rows if e == "procedure")
    assert [(p["name"], p["direction"], p["by_ref"]) for p in proc["parameters"]] == [("a", "IN", False), ("P_OUT", "OUT", True), ("x", "IN", True)] and proc["return_type"] == "Boolean"
    assert [(x["callee"], x["kind"], x["arguments"]) for e, x in rows if e == "call"] == [("Bar", "DYNAMIC", ["1", "G(2, 3)"]), ("G", "STATIC", ["2", "3"]), ("Thing", "EXTERNAL", [])]
    assert [x["value"] for e, x in rows if e == "state_write"] == ["CRIADO"]


def test_sql_facts():
    a = analyse("SELECT a.x FROM s.t1 a JOIN v_two b ON a.id = b.id")
    assert (a["operation"], a["tables"], a["views"], a["columns"], a["access_mode"]) == ("SELECT", ["t1", "v_two"], ["v_two"], ["x", "id"], "READ")
    assert analyse("{call p.q(?, ?)}")["procedure_name"] == "p.q" and analyse("{call .q(?)}")["parse_status"] == "PARTIAL"
    assert analyse("nonsense")["parse_status"] == "UNKNOWN" and analyse("")["notes"] == ["empty statement"]
    assert analyse("WITH c AS (SELECT 1 FROM b) SELECT * FROM c")["tables"] == ["b"]


def test_system(engine):
    s = engine.system
    files = {r.file.rsplit("/", 1)[1]: r.status for r in s.files.collect()}
    assert files["Broken.bas"] == "FAILED" and files["Orders.bas"] == "OK"
    calls = {(r.caller_id, r.callee): (r.kind, r.callee_id) for r in s.calls.collect()}
    assert calls["PROC-ORDERS-PLACEORDER", "IsKnown"] == ("DYNAMIC", "PROC-CHECKS-ISKNOWN")
    assert calls["PROC-ORDERS-NOTIFY", "MsgBox"] == ("EXTERNAL", None)
    objects = {r.id: r for r in s.objects.collect()}
    assert {"TABLE-ORDERS", "TABLE-CUSTOMERS", "VIEW-V_CUSTOMERS", "DBPROC-AUDIT_LOG_ENTRY"} <= set(objects)
    assert objects["DBPROC-AUDIT_LOG_ENTRY"].out_params == ["P_RESULT"]
    assert {(r.from_state, r.to_state, r.evidence) for r in s.transitions.collect()} == {("UNKNOWN", "BLOCKED", "OBSERVATION"), ("UNKNOWN", "PLACED", "OBSERVATION"), ("BLOCKED", "PLACED", "INFERENCE")}
    assert {r.component: r.orphan for r in s.declarations.collect()} == {"Main.frm": False, "Orders": False, "Gone": True, "Store": False}
    ids = [r.id for r in engine.nodes.collect()]
    assert len(ids) == len(set(ids))
    ends = {x for r in engine.edges.collect() for x in (r.source, r.target)}
    assert ends <= set(ids)
    kinds = {r.kind for r in engine.edges.collect()}
    assert {"CONTAINS", "CALLS", "HAS_PARAMETER", "WRITES", "INVOKES", "ENTRY_TO", "DEPENDS_ON"} <= kinds


def test_entries(engine, spark):
    assert resolve_entry(engine.nodes, "mainform.cmdsave_click").startswith("ENTRY-")
    assert resolve_entry(engine.nodes, "IsPositive") == "PROC-CHECKS-ISPOSITIVE"
    with pytest.raises(EntryNotFound):
        resolve_entry(engine.nodes, "nobody")
    two = spark.createDataFrame([("P-A-X", "PROCEDURE", "A.X"), ("P-B-X", "PROCEDURE", "B.X")], "id string, kind string, label string")
    with pytest.raises(EntryNotFound, match="ambiguous"):
        resolve_entry(two, "x")
    assert resolve_entry(two, "B.X") == "P-B-X"


def test_whole_way(engine, spark, tmp_path):
    found = engine.slice("MainForm.cmdSave_Click", 6)
    assert "s3cr et" not in open(engine.write_slice(found)).read()
    assert engine.read_slice(engine.write_slice(found))["n_nodes"] == found["flow"]["n_nodes"]
    assert not found["flow"]["truncated"] and engine.slice("MainForm.cmdSave_Click", 1)["flow"]["truncated"]
    cat, rejected = engine.extract_rules(found)
    rules = {r.name: r for r in cat.collect()}
    assert set(rules) == {"Reject when IsKnown is false", "Branch when total > creditLimit", "Branch when rs.EOF = True"}
    assert rejected.count() == 0 and all(r.status == "candidate" and r.confidence == "medium" for r in rules.values())
    again, _ = engine.extract_rules(found)
    assert sorted(map(str, again.collect())) == sorted(map(str, cat.collect()))
    with pytest.raises(ContractError):
        engine.contract()
    with pytest.raises(ValueError):
        engine.review("Branch when total > creditLimit", "approve")
    engine.review("Branch when total > creditLimit", "approve", "ana")
    engine.review(rules["Reject when IsKnown is false"].rule_id, "approve", "ana", "seen")
    doc = yaml.safe_load(open(engine.contract()))
    ops = [o for p in doc["paths"].values() for o in p.values()]
    assert sorted(o["operationId"] for o in ops) == ["branchWhenTotalCreditLimit", "rejectWhenIsKnownIsFalse"]
    assert sum("422" in o["responses"] for o in ops) == 1 and doc["components"]["schemas"]["LegacyState"]["enum"] == ["BLOCKED", "PLACED"]
    credit, known = rules["Branch when total > creditLimit"].rule_id, rules["Reject when IsKnown is false"].rule_id
    case = lambda i, given, want, **kw: {"id": i, "in_params": given, "out_params": want, "evidence": "Manual observation", **kw}
    cases = [
        case("a", {"total": "9", "creditLimit": "5"}, {credit: "fired"}),
        case("b", {"total": "4", "creditLimit": "5"}, {credit: "fired"}),
        case("c", {}, {known: "reject"}),
        case("d", {"total": 10, "creditLimit": 9}, {credit: "fired", "RULE-X-001": "accept"}, confidence="low"),
        case("e", {"total": 1}, {"approved": True}),
        {"id": "f", "evidence": "legacy execution", "state_trace": ["PLACED"]},
    ]
    path = tmp_path / "cases.yaml"
    path.write_text(yaml.safe_dump({"cases": cases}))
    results, records, totals = engine.verify(str(path))
    assert {r.case_id: r.status for r in results.collect()} == {"a": "PASSED", "b": "FAILED", "c": "SKIPPED", "d": "FAILED", "e": "FAILED", "f": "SKIPPED"}
    by = {r.case_id: r for r in records.where("case_id IN ('b', 'd')").collect()}
    assert by["b"].divergence_id == "DIV-b-01" and by["b"].blocking and by["b"].status == "REQUIRES_REVIEW" and "Orders.bas" in by["b"].source
    assert by["d"].status == "MISSING_IN_NEW" and not by["d"].blocking
    t = totals.first()
    assert (t.passed, t.failed, t.skipped, t.ok_strict) == (1, 3, 2, False)
    text = open(engine.report((results, records, totals))).read()
    assert "DIV-b-01" in text and "Broken.bas" in text and "# Graph" in text
    with pytest.raises(NotAvailable):
        engine.generate_code()


def test_exports(engine, spark):
    csv, edges, js, gml = engine.export()
    assert spark.read.option("header", True).csv(csv).count() == engine.nodes.count()
    assert spark.read.json(js).count() == engine.nodes.count() + engine.edges.count()
    root = ET.fromstring("\n".join(r.value for r in spark.read.text(gml).collect()))
    assert len(root.findall(".//{*}node")) == engine.nodes.count()


def test_refusals(spark, tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text(yaml.safe_dump([{"id": "x", "expected": {"a": 1}, "evidence": "hearsay"}]))
    with pytest.raises(catalogs.CatalogError):
        catalogs.load_cases(spark, str(p))
    p.write_text(yaml.safe_dump([{"id": "x", "evidence": "database trace"}]))
    with pytest.raises(catalogs.CatalogError):
        catalogs.load_cases(spark, str(p))
    p.write_text(yaml.safe_dump({"system_id": "other", "rules": []}))
    with pytest.raises(catalogs.CatalogError):
        catalogs.load_rules(spark, str(p), "mine")
    assert catalogs.load_rules(spark, str(tmp_path / "none.yaml"), "mine").count() == 0


def test_command_line(spark, engine, tmp_path, capsys):
    run = lambda *a: cli.main(["--home", str(tmp_path), "--system", "shop", *a], spark)
    src = f"file://{engine.src}"
    assert run("analyze", src) == 1
    assert run("slice", src, "Orders.PlaceOrder") == 0 and "FLOW-ORDERS_PLACEORDER" in capsys.readouterr().out
    assert run("slice", src, "nobody") == 2
    assert run("extract-rules", src, "Orders.PlaceOrder") == 0
    assert run("validate") == 1 and run("contract", src) == 2 and run("generate") == 2
    assert run("review-all", "--reviewer", "ana") == 0 and run("validate") == 0 and run("contract", src) == 0
    assert run("rules", "--status", "validated") == 0 and "RULE-" in capsys.readouterr().out


def test_text_functions(spark):
    df = spark.createDataFrame([("Ação & Co",), ("",), ("a" * 70,)], "s string")
    assert [r[0] for r in df.select(slug_unicode("s")).collect()] == ["ACAO_CO", "UNNAMED", "A" * 60]
    assert slug_text("x-y") == "X_Y" and df.select(slug("s")).collect()[1][0] == "UNNAMED"
    js = spark.createDataFrame([('{"a": {"password": [1], "u": "https://me:pw@h"}}',), ("no json, token=abc",)], "s string")
    assert [r[0] for r in js.select(redact_json("s")).collect()] == ['{"a": {"password": "[REDACTED] (list omitted)", "u": "https://[REDACTED]@h"}}', "no json, token=[REDACTED]"]


def test_simulator(spark):
    cases = spark.createDataFrame([("c", "F", {"a": "10", "b": "9", "s": "x"})], "case_id string, flow_id string, inputs map<string,string>")
    rules = [("1", "F", "a > b", "reject"), ("2", "F", "a < b", "reject"), ("3", None, "s = 'x'", "unknown"), ("4", "G", "a > b", "accept"), ("5", "F", "a > missing", "accept"), ("6", "F", "IsX(a)", "accept"), ("7", "F", 's = "y" Or s = "x"', "accept"), ("8", "F", "s >= 2", "accept")]
    got = {r.rule_id: r.got for r in rl.simulate(cases, spark.createDataFrame(rules, "rule_id string, flow_id string, expression string, behavior_type string")).collect()}
    assert got == {"1": "reject", "2": "not_fired", "3": "fired", "5": "unknown", "6": "unknown", "7": "unknown", "8": "accept"}


def test_graph_edges(spark):
    nodes = spark.createDataFrame([(f"n{i}", "PROCEDURE", f"n{i}") for i in range(12)], "id string, kind string, label string")
    full = spark.createDataFrame([("CALLS", f"n{i}", f"n{j}") for i in range(12) for j in range(12) if i != j], "kind string, source string, target string")
    members, used = g.communities(nodes, full)
    row = g.cluster_stats(members, full).first()
    assert used == "components" and row.is_giant and row["size"] == 12 and row.cohesion == 1.0
    two = nodes.limit(2)
    assert g.communities(two, full)[1] == "singleton" and g.communities(two, full)[0].select("root").distinct().count() == 1
    lone = g.cluster_stats(*[g.communities(nodes, full.limit(0))[0], full.limit(0)])
    assert lone.where("is_giant").count() == 0 and lone.count() == 12
    loop = spark.createDataFrame([("n0", "n0"), ("n0", "n1")], "source string, target string")
    degree = {r.id: r.degree for r in g.node_degree(nodes, loop).collect()}
    assert degree["n0"] == 2 and degree["n1"] == 1 and degree["n2"] == 0
    with pytest.raises(ValueError):
        g.reach(loop, nodes, 0)


def test_components_match_union_find(spark):
    import random

    rnd = random.Random(3)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(1000, 1400), rnd.randrange(1000, 1400)) for _ in range(220)] + [(5, i) for i in range(2000, 2100)] + [(7, 7), (8, 9), (8, 9)]
    rnd.shuffle(pairs)
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    rename = rnd.sample(range(10_000), 3000)
    want = {}
    for x in parent:
        want.setdefault(root(x), []).append(rename[x])
    df = spark.createDataFrame([(rename[a], rename[b]) for a, b in pairs], "src long, dst long")
    got = {r.node: r.root for r in g.connected(df).collect()}
    assert got == {x: min(members) for members in want.values() for x in members}
    assert g.connected(df.limit(0)).count() == 0


def test_run_log(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    with runlog.timed(spark, path, "analyze", source="dbPassword=abc") as d:
        d["files"] = "6"
    with pytest.raises(KeyError):
        with runlog.timed(spark, path, "slice"):
            raise KeyError("x")
    rows = {r.stage: r for r in runlog.read(spark, path).collect()}
    assert rows["slice"].details["error"] == "KeyError" and rows["analyze"].source == "dbPassword=[REDACTED]" and rows["analyze"].duration_ms > 0
    q = runlog.stage_counts(runlog.read_stream(spark, path)).writeStream.outputMode("complete").format("memory").queryName("log_counts").start()
    q.processAllAvailable()
    q.stop()
    assert {r.stage: r.n for r in spark.table("log_counts").collect()} == {"analyze": 1, "slice": 1}
    assert F is not None
