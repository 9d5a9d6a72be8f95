"""That the engine uses what the operators offer: cache, types, flows, dependencies, logs, traces, exports."""

import sqlite3
import sys

import pytest
import yaml
from pyspark.sql import functions as F

from quarrylens.facade import Engine
from quarrylens.operators import graph as g
from quarrylens.operators import model
from quarrylens.operators import verify as vf
from quarrylens.sources import ast, catalogs
from quarrylens.sources.vb6 import assignment, extract, split_statements, tokenize
from quarrylens.streaming import runlog

A = 'Attribute VB_Name = "{0}"\nPublic Function Save(x) As Boolean\n  Save = True\nEnd Function\nPublic Function Load2(x) As Boolean\n  Load2 = True\nEnd Function\n'
SOURCES = {
    "Alpha.cls": A.format("Alpha"),
    "Beta.cls": A.format("Beta"),
    "Use.bas": """Attribute VB_Name = "Use"
Public shared As Alpha
Public Sub Go(p As Beta)
    Dim a As Alpha
    Dim b, c
    a.Save 1
    Set b = New Beta
    b.Save 2
    Set c = b
    c.Load2 3
    p.Save 4
    shared.Load2 5
    Set b = a
    Unknown.Save 6
    Beta.Save 7
    Save 8
End Sub
""",
}


def frame(spark, files):
    return spark.createDataFrame([(k, v) for k, v in files.items()], "file string, content string")


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, "typed", str(tmp_path_factory.mktemp("typed")))
    deps = spark.createDataFrame([("CMP-USE", "CMP-BETA", "by hand"), ("CMP-USE", "CMP-NOWHERE", "lost"), ("PROC-ALPHA-SAVE", "PROC-BETA-SAVE", "copies")], "source string, target string, label string")
    e.analyse(sources=frame(spark, SOURCES), by_type=True, dependencies=deps)
    return e


def test_assignments():
    one = lambda t: assignment(split_statements(t, tokenize(t))[0])
    assert one("Set x = New Alpha\n") == {"target": "x", "type_name": "Alpha", "source": None, "line": 1}
    assert one("  set Me.y = z\n") == {"target": "y", "type_name": None, "source": "z", "line": 1}
    assert one("Set rs = Store.OpenSql(1)\n") is None and one("x = y\n") is None


def test_calls_by_type(engine):
    got = {r.expression: (r.callee_id, r.kind) for r in engine.system.calls.where("procedure = 'Go'").collect()}
    assert got["a.Save 1"] == ("PROC-ALPHA-SAVE", "DYNAMIC")
    # b was given a Beta and later an Alpha
    assert got["b.Save 2"] == (None, "UNRESOLVED") and got["c.Load2 3"] == (None, "UNRESOLVED")
    assert got["p.Save 4"] == ("PROC-BETA-SAVE", "DYNAMIC") and got["shared.Load2 5"] == ("PROC-ALPHA-LOAD2", "DYNAMIC")
    assert got["Unknown.Save 6"] == (None, "UNRESOLVED") and got["Beta.Save 7"] == ("PROC-BETA-SAVE", "DYNAMIC") and got["Save 8"] == (None, "UNRESOLVED")


def test_types_of_cycles(spark):
    declared = spark.createDataFrame([("a", "T"), ("z", "U"), (None, "V")], "var string, type string")
    assigned = spark.createDataFrame([("b", "a"), ("c", "b"), ("b", "c"), ("c", "c"), ("c", "z"), ("x", "y"), ("y", "x")], "var string, source string")
    got = {(r.var, r.type) for r in model.infer_types(declared, assigned).collect()}
    assert got == {("a", "T"), ("z", "U"), ("b", "T"), ("c", "T"), ("c", "U"), ("b", "U")}


def test_dependencies_and_flows_are_in_the_graph(engine):
    edges = {(r.source, r.target, r.label) for r in engine.edges.where("kind = 'DEPENDS_ON'").collect()}
    assert ("CMP-USE", "CMP-BETA", "by hand") in edges and ("PROC-ALPHA-SAVE", "PROC-BETA-SAVE", "copies") in edges
    assert not any("NOWHERE" in t for _, t, _ in edges)
    summary, reached = engine.slices(4)
    one = {r.entry: r for r in summary.collect()}
    entries = {r.id for r in engine.nodes.where("kind = 'ENTRY'").collect()}
    assert set(one) == entries and one["ENTRY-USE_GO-P"].n_procedures >= 3 and one["ENTRY-USE_GO-P"].tokens > 0
    single = engine.slice("Use.Go", 4)["nodes"]
    assert {(r.id, r.distance) for r in reached.where("entry = 'ENTRY-USE_GO-P'").collect()} >= {(r.id, r.distance) for r in single.where("distance = 0").collect()}
    flows = {r.id: r for r in engine.flows(4).collect()}
    assert "FLOW-USE_GO" in flows
    assert {r.id for r in engine.nodes.where("kind = 'FLOW'").collect()} == set(flows)
    held = {(r.source, r.target) for r in engine.edges.where("label = 'contains'").collect()}
    assert ("FLOW-USE_GO", "PROC-ALPHA-SAVE") in held


def test_slice_as_the_user_gets_it(engine):
    found = engine.slice("Use.Go", 4)
    flow = found["flow"]
    assert {"PROC-USE-GO", "PROC-ALPHA-SAVE", "PROC-BETA-SAVE"} <= set(flow["procedure_ids"]) and flow["sql_ids"] == [] and flow["context_token_estimate"] > 20
    assert set(flow["cluster_ids"]) == {r.root for r in found["clusters"].collect()}
    assert engine.slice("Use.Go", 1)["flow"]["warnings"][0] == "more may lie beyond the bound"
    back = engine.read_slice(engine.write_slice(found))
    assert back["procedure_ids"] == flow["procedure_ids"] and back["sql_ids"] == []


def test_exports_have_clusters_hubs_and_flows(engine, spark):
    engine.flows(4)
    csv, _, _, gml = engine.export()
    rows = spark.read.option("header", True).csv(csv)
    assert rows.columns == ["id", "kind", "label", "file", "line", "cluster_id", "degree", "degree_centrality", "betweenness"]
    assert rows.where("kind = 'PROCEDURE' AND cluster_id IS NULL").count() == 0 and rows.where("CAST(betweenness AS DOUBLE) > 0").count() > 0
    text = "\n".join(r.value for r in spark.read.text(gml).orderBy(F.input_file_name(), F.monotonically_increasing_id()).collect())
    assert text.startswith("<?xml") and text.endswith("</graphml>") and 'key="cluster_id">' in text
    db = sqlite3.connect(engine.export_sqlite())
    assert db.execute("SELECT count(*) FROM flows").fetchone()[0] == engine.flow_table.count()
    ids = db.execute("SELECT id, reason FROM hubs").fetchall()
    assert ids and all(i.startswith("HUB-") and "links" in reason for i, reason in ids)
    assert db.execute("SELECT count(*) FROM nodes WHERE cluster_id IS NOT NULL AND degree > 0").fetchone()[0] > 0


def test_stages_leave_records(engine, spark):
    records = runlog.read(spark, engine.log_path)
    stages = {r.stage for r in records.collect()}
    assert {"analyse", "slice", "slices"} <= stages
    assert records.where("stage = 'analyse'").first().details["nodes"] and records.where("duration_ms IS NULL OR system_id <> 'typed'").count() == 0


def test_only_changed_files_are_read_again(spark, tmp_path):
    cache, same = f"file://{tmp_path}/cache", lambda s: sorted(map(str, s.calls.drop("id").collect()))
    e = Engine(spark, "x", str(tmp_path / "home"))
    origins = lambda: {k: v for k, v in runlog.read(spark, e.log_path).orderBy(F.col("timestamp").desc()).first().details.items() if k.startswith("files_")}
    e.analyse(sources=frame(spark, SOURCES), cache=cache)
    assert origins() == {"files_own": "3"}
    whole = Engine(spark, "y", str(tmp_path / "other"))
    whole.analyse(sources=frame(spark, SOURCES))
    assert same(e.system) == same(whole.system) and sorted(map(str, e.edges.collect())) == sorted(map(str, whole.edges.collect()))
    changed = SOURCES | {"Beta.cls": SOURCES["Beta.cls"].replace("Load2", "Load3"), "New.bas": SOURCES["Alpha.cls"].replace("Alpha", "New")}
    e.analyse(sources=frame(spark, changed), cache=cache)
    assert origins() == {"files_cache": "2", "files_own": "2"}
    whole.analyse(sources=frame(spark, changed))
    assert sorted(map(str, e.nodes.collect())) == sorted(map(str, whole.nodes.collect())) and sorted(map(str, e.edges.collect())) == sorted(map(str, whole.edges.collect()))


def test_external_parser_comes_first(spark, tmp_path):
    script = tmp_path / "parse.py"
    script.write_text("import json, sys\nt = sys.stdin.read()\nif 'Beta' in t[:40]: sys.exit(3)\nprint(json.dumps({'component': 'X' + str(len(t) % 7), 'language': 'vb', 'procedures': [{'name': 'Do', 'kind': 'sub'}]}))\n")
    e = Engine(spark, "x", str(tmp_path / "home"))
    s = e.analyse(sources=frame(spark, {k: v for k, v in SOURCES.items() if k != "Use.bas"}), parser=[sys.executable, str(script)], cache=f"file://{tmp_path}/cache")
    assert {r.name for r in s.components.collect()} == {"Beta", f"X{len(SOURCES['Alpha.cls']) % 7}"}
    assert {r.name for r in s.procedures.collect()} == {"Save", "Load2", "Do"}
    broken = spark.createDataFrame([("f", "h", "v", "FAILED", None, "exit code 3")], ast.SCHEMA)
    assert [(r.entity, '"status":"FAILED"' in r.payload) for r in ast.entities(broken).collect()] == [("file", True)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0] + [max(row[j + 1], row[j] + 1 if x == y else 0) for j, y in enumerate(b)]
        for j in range(1, len(row)):
            row[j] = max(row[j], row[j - 1])
    return row[-1]


def test_traces_match_plain_alignment(spark):
    import random

    rnd = random.Random(1)
    pairs = [([rnd.choice("ABC") for _ in range(rnd.randint(0, 12))], [rnd.choice("ABC") for _ in range(rnd.randint(0, 12))]) for _ in range(200)]
    pairs += [(["A"], ["A"]), (["A", "B"], ["A"]), (["A"], ["A", "B"]), (list("ABAB") * 30, list("BABA") * 30)]
    e = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)] + [(9000, None), (9001, ["A"])], "case_id int, trace array<string>")
    o = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(pairs)] + [(9000, ["A"]), (9002, ["A"])], "case_id int, trace array<string>")
    got = {r.case_id: r for r in vf.compare_traces(e, o).collect()}
    for i, (a, b) in enumerate(pairs):
        r = got[i]
        if not a:
            assert r.outcome == "undecidable"
            continue
        first = next((k for k in range(max(len(a), len(b))) if a[k : k + 1] != b[k : k + 1]), None)
        assert (r.n_common, r.first, r.outcome) == (lcs(a, b), first, "match" if a == b else "divergence"), (a, b)
    assert got[9000].outcome == "undecidable" and got[9001].outcome == "divergence" and "absent" in got[9001].detail and 9002 not in got


def test_verify_compares_traces_that_are_given(engine, spark, tmp_path):
    cases = [{"id": i, "evidence": "legacy execution", "state_trace": ["NEW", "PAID", "SENT"]} for i in ("a", "b", "c")]
    path = tmp_path / "cases.yaml"
    path.write_text(yaml.safe_dump({"cases": cases}))
    assert {r.status for r in engine.verify(str(path))[0].collect()} == {"SKIPPED"}
    seen = spark.createDataFrame([("a", ["NEW", "PAID", "SENT"]), ("b", ["NEW", "SENT"])], "case_id string, trace array<string>")
    results, records, totals = engine.verify(str(path), traces=lambda cases: seen)
    assert {r.case_id: r.status for r in results.collect()} == {"a": "PASSED", "b": "FAILED", "c": "FAILED"}
    by = {r.case_id: r for r in records.collect()}
    assert by["b"].summary == "state_trace: at 1 expected PAID, got SENT; 2 of 3 states in order" and by["c"].status == "MISSING_IN_NEW"
    assert totals.first().failed == 2


def rule(i, **more):
    return {"rule_id": f"RULE-{i}", "name": f"rule {i}", "status": "candidate", "confidence": "medium"} | more


def rules(spark, *rows):
    return spark.createDataFrame([tuple(r.get(k) for k in ("rule_id", "name", "status", "confidence")) for r in rows], "rule_id string, name string, status string, confidence string")


def test_two_writers_lose_nothing(spark, tmp_path):
    one, two = (catalogs.RuleLog(spark, f"file://{tmp_path}/rules", "s") for _ in range(2))
    assert one.rules().count() == 0
    # both have looked before either writes
    one.add(rules(spark, rule(1), rule(2)))
    two.add(rules(spark, rule(2, name="again"), rule(3)))
    decide = lambda log, *rows: log.decide(spark.createDataFrame(rows, catalogs.DECISION_SCHEMA))
    decide(one, ("RULE-1", "approve", "ana", "2024-01-01", "ok"))
    decide(two, ("RULE-3", "reject", "bob", "2024-01-01", None), ("RULE-2", "approve", "bob", "2024-01-02", None))
    decide(one, ("RULE-2", "reset", None, "2024-01-03", None))
    two.add(rules(spark, rule(1, name="late")))
    got = {r.rule_id: (r.name, r.status, r.confidence, r.reviewed_by, r.reviewed_at) for r in two.rules().collect()}
    assert got == {
        "RULE-1": ("rule 1", "validated", "high", "ana", "2024-01-01"),
        "RULE-2": ("rule 2", "candidate", "medium", None, None),
        "RULE-3": ("rule 3", "rejected", "medium", "bob", "2024-01-01"),
    }
    with pytest.raises(ValueError):
        decide(one, ("RULE-1", "approve", " ", "2024-01-05", None))
    with pytest.raises(catalogs.CatalogError):
        catalogs.RuleLog(spark, f"file://{tmp_path}/rules", "other").rules()


def test_catalog_to_yaml_and_back(spark, tmp_path):
    e, f = Engine(spark, "s", str(tmp_path / "e")), Engine(spark, "s", str(tmp_path / "f"))
    e.rule_log.add(rules(spark, rule(1), rule(2)))
    e.review("rule 2", "reject", "ana", "no")
    path = e.export_catalog()
    f.import_catalog(path)
    assert sorted(map(str, f.catalog().collect())) == sorted(map(str, e.catalog().collect()))
    assert {r.rule_id: r.reviewed_by for r in f.catalog().collect()} == {"RULE-1": None, "RULE-2": "ana"}


def test_hub_ids_come_from_the_operator(spark):
    central = spark.createDataFrame([("a", "TABLE", "orders", 9, 0.9), ("b", "TABLE", "Items", 9, 0.9), ("c", "TABLE", "x", 2, 0.2), ("d", "SQL", "y", 9, 0.9)], "id string, kind string, label string, links long, centrality double")
    between = spark.createDataFrame([("b", 0.5)], "id string, betweenness double")
    assert [(r.rank, r.hub_id) for r in g.hubs(central, ["TABLE"], between).orderBy("rank").collect()] == [(1, "HUB-ITEMS-00"), (2, "HUB-ORDERS-01")]


def test_extraction_is_the_same_through_documents(spark):
    src = frame(spark, SOURCES)
    direct = sorted((r.file, r.seq, r.entity, r.payload) for r in extract(src).collect())
    through = sorted((r.file, r.seq, r.entity, r.payload) for r in ast.entities(ast.acquire(src, "v")).collect())
    assert direct == through
