import sys

from pyspark.sql import functions as F

from quarrylens.functions import prompts
from quarrylens.operators.lineage import cut
from sample import FILES
from quarrylens.sources import ast
from quarrylens.sources.vb6 import decode


def sources(spark):
    return spark.createDataFrame(list(FILES.items()), "file string, content string")


def test_acquisition_order(spark, tmp_path):
    first = cut(ast.acquire(sources(spark), "1"))
    rows = {r.file: r for r in first.collect()}
    assert len(rows) == len(FILES) and {r.origin for r in rows.values()} == {"own"}
    assert rows["app/Broken.bas"].status == "FAILED" and rows["app/Orders.bas"].status == "OK"
    ast.store(first.where("file = 'app/Orders.bas'"), f"file://{tmp_path}/cache")
    cache = spark.read.parquet(f"file://{tmp_path}/cache")
    script = "import sys, json; t = sys.stdin.read(); sys.exit(3) if 'Store' in t else print(json.dumps({'name': 'x', 'procedures': []}))"
    again = {r.file: r for r in ast.acquire(sources(spark), "1", cache, [sys.executable, "-c", script]).collect()}
    assert again["app/Orders.bas"].origin == "cache" and again["app/Broken.bas"].origin == "external"
    assert again["app/Checks.bas"].origin == "own" and again["app/Checks.bas"].status == "PARTIAL" and again["app/Checks.bas"].note == "exit code 3"
    other = {r.file: r.origin for r in ast.acquire(sources(spark), "2", cache).collect()}
    assert other["app/Orders.bas"] == "own"


def test_foreign_documents(spark):
    df = spark.createDataFrame([("a", '{"module": "M", "functions": [{"name": "f"}]}'), ("b", '{"name": "N"}'), ("c", "[]"), ("d", "no json")], "file string, document string")
    assert {r.file: r.status for r in ast.translate(df).collect()} == {"a": "OK", "b": "PARTIAL", "c": "UNKNOWN", "d": "UNKNOWN"}


def test_artifacts(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.java").write_text("class X {}")
    (tmp_path / "api.yaml").write_text("operationId: a\noperationId: b\n")
    assert {r.extension: (r.files, r.operations) for r in ast.artifacts(spark, f"file://{tmp_path}").collect()} == {"java": (1, 0), "yaml": (1, 2)}


def test_decoding():
    assert decode("é".encode()) == "é" and decode(b"\xe9") == "é" and decode(b"\x81\xe9") == "\x81é"


def test_prompts(spark):
    df = spark.createDataFrame([("f", "p", 'pwd="x"')], "fragment string, procedure string, text string")
    row = prompts.context(df, "be brief").first()
    assert "[REDACTED]" in row.context and row.tokens > 1
    assert df.select(prompts.render("a {text} b", text=F.col("procedure"))).first()[0] == "a p b"
    answers = spark.createDataFrame([('so:\n```json\n[{"name": "n", "observation": ["o"]}, {"name": " "}]\n```',), ("nothing",)], "answer string")
    good, bad = prompts.candidates(answers)
    assert [r.name for r in good.collect()] == ["n"] and sorted(r.reason for r in bad.collect()) == ["no JSON array", "no name"]


def test_scanned_rows_are_those_of_the_extraction(spark, monkeypatch):
    from quarrylens.sources import vb6

    monkeypatch.setattr(vb6, "BLOCK", 5)
    texts = [("a.bas", 'Rem x _\nSub A()\n10 Rem "open\n  MsgBox "a" & _\n  1 \' c\nEnd Sub'), ("b.vbp", "Form=b.frm"), ("c.bas", 'x = "open'), ("d.cls", "")]
    df = spark.createDataFrame(texts, "file string, content string")
    both = vb6.extract(df, True)
    for kind in ("token", "statement"):
        want = vb6.entity(both, kind).drop("seq").collect()
        assert sorted(map(str, vb6.scanned(df, kind).collect())) == sorted(map(str, want)) and want


def test_rows_leave_a_task_in_blocks(monkeypatch):
    """What Python holds of many files does not grow with their number."""
    from quarrylens.sources import vb6

    class Frame:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            return run

    monkeypatch.setattr(vb6, "BLOCK", 50)
    files = vb6.pd.DataFrame({"file": [f"{i}.bas" for i in range(40)], "content": ["Sub A()\nx = 1\nEnd Sub\n"] * 40})
    for run in (vb6.extract(Frame(), True), vb6.scanned(Frame(), "token"), vb6.scanned(Frame(), "statement")):
        blocks = list(run(iter([files])))
        assert len(blocks) > 1 and max(map(len, blocks)) < 100 and len({f for b in blocks for f in b["file"]}) == 40


def test_files_are_spread_whatever_their_size(spark, sf):
    from quarrylens.plans.vb6_queries import sources

    assert sources(spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_operations_are_read_in_many_tasks_and_without_objects(spark, sf, monkeypatch):
    from quarrylens.functions import sqlfacts
    from quarrylens.plans.domain_queries import sql_access_mode

    assert sql_access_mode(spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = ["WITH a AS (SELECT 1) DELETE FROM t; SELECT 2", "call a.b(1)", "(SELECT 1)", "DELETE )(", "", None]
    want = [sqlfacts.analyse(x)["operation"] for x in texts]
    monkeypatch.setattr(sqlfacts, "_objects", None)
    assert [sqlfacts._head(x)["operation"] for x in texts] == want == ["DELETE", "CALL", "SELECT", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
