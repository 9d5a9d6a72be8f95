"""Settings, SQLite, HTTP answers, code generation and reports."""

import pytest

from quarrylens import codegen, report, settings
from quarrylens.facade import Engine, NotAvailable
from quarrylens.operators.answers import http_answers
from sample import FILES
from quarrylens.sources import exports, sqlite


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# note\nQUARRYLENS_ROOT='/data'\nexport QUARRYLENS_PARSER_TIMEOUT=7\nOTHER=1\nQUARRYLENS_CATALOG=/x/r.yaml\n")
    s = settings.load({"quarrylens_catalog": "/y/r.yaml", "QUARRYLENS_NO_SUCH": "1"}, tmp_path)
    assert (str(s.root), str(s.home), str(s.catalog), s.parser_timeout, s.generator_timeout) == ("/data", "/data/out", "/y/r.yaml", 7, 900)
    assert settings.load({}, tmp_path / "none").root == tmp_path / "none"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, "shop", str(tmp_path_factory.mktemp("home")))
    e.analyse(sources=spark.createDataFrame(list(FILES.items()), "file string, content string"))
    return e


def test_sqlite(spark, engine, tmp_path):
    path = engine.export_sqlite()
    nodes = sqlite.read_sqlite(spark, path)
    ids = [r.id for r in nodes.collect()]
    assert ids == sorted(r.id for r in engine.nodes.collect())
    assert nodes.where("cluster_id IS NOT NULL AND degree > 0").count() > 10
    assert sqlite.read_sqlite(spark, path, "edges").count() == engine.edges.count()
    assert sqlite.read_sqlite(spark, path, "meta").where("value = 'shop'").count() == 1
    twice = spark.createDataFrame([("a", "x"), ("a", "y")], "key string, value string").coalesce(1)
    assert [r.value for r in sqlite.read_sqlite(spark, sqlite.write_sqlite(tmp_path / "t.db", meta=twice), "meta").collect()] == ["y"]


def test_slice_file_of_its_own(spark, engine):
    found = engine.slice("MainForm.cmdSave_Click", 6)
    row = spark.read.json(exports.slice_json(found["flow"], found["nodes"], found["edges"], found["fragments"], standalone=True).rdd.map(lambda r: r.value)).first()
    assert row.context_token_estimate > 0 and len(row.source_fragments) == found["fragments"].count() and not hasattr(row, "fragments")


def test_http_answers(spark):
    cases = spark.createDataFrame([("c1", "A", {"x": "1"}), ("c2", None, None)], "case_id string, flow_id string, inputs map<string,string>")

    def send(url, body, timeout):
        assert url == "http://new/verify" and timeout == 3
        return {"R1": body["inputs"].get("x"), "R2": True} if body["case_id"] == "c1" else {}

    got = {(r.case_id, r.rule_id): r.got for r in http_answers("http://new/", 3, send)(cases, None).collect()}
    assert got == {("c1", "R1"): "1", ("c1", "R2"): "true"}
    with pytest.raises(ValueError):
        http_answers("")

    def fail(url, body, timeout):
        raise RuntimeError("the new system answered with HTTP 500")

    with pytest.raises(Exception, match="HTTP 500"):
        http_answers("http://new", 3, fail)(cases, None).collect()


def test_code_generation(engine, tmp_path):
    contract = tmp_path / "c.yaml"
    contract.write_text("openapi: 3.0.3\n")
    calls = []

    def runner(command, folder, timeout):
        calls.append(command)
        made = folder / "src/main/java/A.java"
        made.parent.mkdir(parents=True, exist_ok=True)
        made.write_text("class A {}")
        (folder / "pom.xml").write_text("<project/>")
        if command[0] == "mvn":
            (folder / "target/classes").mkdir(parents=True)
            (folder / "target/classes/A.class").write_bytes(b"x")
        return 0, "fine"

    made = codegen.generate(contract, tmp_path / "out", "a.b; rm", runner=runner)
    assert len(made.sources) == 1 and "not compiled" in made.summary() and "modelPackage=a.b; rm.model" in calls[0][-1]
    assert codegen.compile_java(made, runner=runner).compiled and "1 classes" in made.summary()
    failed = codegen.compile_java(made, runner=lambda *a: (1, "broken"))
    assert not failed.compiled and failed.error == "broken"
    for code, said in ((2, "no"), (0, "nothing made")):
        with pytest.raises(codegen.CodegenError):
            codegen.generate(contract, tmp_path / f"o{code}", "p", runner=lambda *a, c=code, s=said: (c, s))
    with pytest.raises(NotAvailable):
        engine.generate_code()


def test_divergence_report(spark, engine):
    rows = [("DIV-1", "R1", "REQUIRES_REVIEW", "R1: expected a, got b", "a", "b", "x.bas:3", True), ("DIV-2", None, "MISSING_IN_NEW", "gone", "a", None, None, False)]
    records = spark.createDataFrame(rows, "divergence_id string, rule_id string, status string, summary string, legacy string, new_system string, source string, blocking boolean")
    text = report.divergence_report("shop", records)
    assert "2 divergences, 1 of them blocking" in text and "- Source: `x.bas:3`" in text and "MISSING_IN_NEW, advisory" in text and "no answer" in text
    assert "say nothing" in report.divergence_report("shop", records.limit(0))
    path = engine.report()
    text = open(path).read()
    assert "verification was not run" in text and "## From rule to source" in text
