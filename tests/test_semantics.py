"""Expected results by hand, one operator at a time."""

import pytest
from pyspark.sql import functions as F

from quarrylens.functions.sqlfacts import analyse, operation
from quarrylens.operators import graph as g
from quarrylens.operators import lineage, model
from quarrylens.operators import rules as rl
from quarrylens.operators import system as sy
from quarrylens.operators.contract import operations
from quarrylens.sources.vb6 import extract, read_file, split_statements, sql_string, state_domain, state_write, tokenize


def written(text):
    w = state_write(split_statements(text, tokenize(text))[0])
    return w and (w["target"], w["value"], w["shape"], state_domain(w["target"]))


def test_state_writes():
    assert written('obj.estadoGrupo = "CRIADO"') == ("obj.estadoGrupo", "CRIADO", "assignment", "GRUPO")
    assert written('SetStatus id, "PLACED"') == ("SetStatus", "PLACED", "setter", "UNKNOWN")
    assert written('Store.Put estadoAtual, "PLACED"') == ("Put", "PLACED", "setter", "UNKNOWN")
    assert written('Put(rs.fase, adVarChar, "ABERTO")') == ("fase", "ABERTO", "inline_call", "UNKNOWN")
    assert written('resultadoConsistencia = "OK_1"') == ("resultadoConsistencia", "OK_1", "assignment", "CONSISTENCIA")
    # the domain is that of the name; lower case, short values, words of SQL and names that are no states are none
    assert written('SetStatus grupo, "PLACED"')[3] == "UNKNOWN"
    for text in ('SetStatus id, "abc"', 'SetStatus id, "SELECT"', 'estado = "A"', 'estado = "UNKNOWN"', 'estado.nome = "CRIADO"', 'SetStatus(id, "PLACED")'):
        assert written(text) is None, text


def test_sql_of_all_literals():
    find = lambda text: sql_string(split_statements(text, tokenize(text))[0])
    # what SQL is, all literals say together
    assert find('s = "" & "SELECT A FROM T"')["text"] == "SELECT A FROM T"
    assert find('s = "{call a.b(" & "?)}"')["text"] == "{call a.b(?)}"
    assert find('s = "no statement"') is None
    got = find('s = "UPDATE T SET STATUS = \'" & "Posted" & "\'"')
    assert got["state_tokens"] == ["POSTED"] and got["mentions_state_column"]


def test_transitions(spark):
    code = 'Attribute VB_Name = "M"\nSub GravaGrupo()\nfase = "AAA"\nEnd Sub\nSub B()\nfase = "AAA"\n\n\n\nfaseGrupo = "BBB"\nfase = "BBB"\nfase = "AAA"\ns = "UPDATE T SET ESTADO = " & "CCC"\nEnd Sub\n'
    rows = list(read_file("m.bas", code))
    # the procedure's name counts for the domain
    assert [r["domain"] for e, r in rows if e == "state_write"] == ["GRUPO", "UNKNOWN", "GRUPO", "UNKNOWN", "UNKNOWN"]
    got = sy.build(extract(spark.createDataFrame([("m.bas", code)], "file string, content string"))).transitions
    rows = {(r.domain, r.from_state, r.to_state, r.trigger, r.source, r.evidence) for r in got.collect()}
    assert rows == {
        ("GRUPO", "UNKNOWN", "AAA", "M.GravaGrupo", "m.bas:3", "OBSERVATION"),
        # once, at the first place by number of line
        ("UNKNOWN", "UNKNOWN", "AAA", "M.B", "m.bas:6", "OBSERVATION"),
        ("GRUPO", "UNKNOWN", "BBB", "M.B", "m.bas:10", "OBSERVATION"),
        ("UNKNOWN", "UNKNOWN", "BBB", "M.B", "m.bas:11", "OBSERVATION"),
        ("UNKNOWN", "UNKNOWN", "CCC", "M.B", "m.bas:13", "OBSERVATION"),
        ("GRUPO", "AAA", "BBB", "M.B", "m.bas:6", "INFERENCE"),
        ("UNKNOWN", "BBB", "AAA", "M.B", "m.bas:11", "INFERENCE"),
    }


CODE = {
    "a.frm": 'Attribute VB_Name = "Form1"\nPrivate Sub cmd_Click()\n  Save\nEnd Sub\nPrivate Sub Unrelated()\n  Load Other\nEnd Sub\nPublic Sub Save()\n  x = "SELECT a FROM T1 WHERE a = 1"\nEnd Sub\nPrivate Sub AlsoUnrelated()\nEnd Sub\n',
    "b.frm": 'Attribute VB_Name = "Other"\nPrivate Sub Go()\nEnd Sub\n',
}


@pytest.fixture(scope="module")
def system(spark):
    return sy.build(extract(spark.createDataFrame(list(CODE.items()), "file string, content string")))


def test_slice_follows_the_flow_only(spark, system):
    nodes, edges = sy.graph(system)
    start = sy.resolve_entry(nodes, "Form1.cmd_Click")
    reached = {r.id for r in g.reach(g.flow_edges(nodes, edges), spark.createDataFrame([(start,)], "id string"), 9).collect()}
    assert {"PROC-FORM1-CMD_CLICK", "PROC-FORM1-SAVE", "TABLE-T1"} <= reached
    assert not any("UNRELATED" in x for x in reached) and not any(x.startswith(("FILE", "PARAM")) for x in reached)
    executes = edges.where("label = 'executes'").collect()
    assert [(r.kind, r.source) for r in executes] == [("DEPENDS_ON", "PROC-FORM1-SAVE")]


def test_flows_and_dependencies(spark, system):
    flows = spark.createDataFrame([("FLOW-1", "one", ["FLOW-1", "PROC-FORM1-SAVE", "nobody"])], "id string, name string, node_ids array<string>")
    wanted = spark.createDataFrame([("PROC-FORM1-SAVE", "CMP-OTHER", "uses"), ("FILE-A_FRM", "CMP-OTHER", "part"), ("PROC-NONE", "CMP-OTHER", "uses")], "source string, target string, label string")
    nodes, edges = sy.graph(system, flows, wanted)
    assert [(r.kind, r.label) for r in nodes.where("id = 'FLOW-1'").collect()] == [("FLOW", "one")]
    got = {(r.source, r.target, r.label) for r in edges.where("kind = 'DEPENDS_ON'").collect()}
    assert ("FLOW-1", "PROC-FORM1-SAVE", "contains") in got and ("PROC-FORM1-SAVE", "CMP-OTHER", "uses") in got and ("FILE-A_FRM", "CMP-OTHER", "part") in got
    assert not any("nobody" in x or "PROC-NONE" in x for e in got for x in e)


def test_operation_ids(spark):
    rows = [(f"RULE-{i}", n, "validated", None) for i, n in enumerate(["Foo", "Foo", "Foo 2", "Bar", "foo"])]
    ops = operations(spark.createDataFrame(rows, "rule_id string, name string, status string, entry_point_id string"), spark.createDataFrame([], "entry_point_id string, kind string"))
    assert {r.rule_id: (r.operation_id, r.path) for r in ops.collect()} == {"RULE-0": ("foo", "/rules/foo"), "RULE-1": ("foo2", "/rules/foo2"), "RULE-2": ("foo22", "/rules/foo22"), "RULE-3": ("bar", "/rules/bar"), "RULE-4": ("foo3", "/rules/foo3")}


def test_one_answer_for_a_statement(spark):
    texts = ["WITH c AS (SELECT 1 FROM b) SELECT * FROM c", "-- x\nDELETE FROM t", "/* x */ update t set a = 1", "{call p(1)}", "?", None]
    got = [r.op for r in spark.createDataFrame([(t,) for t in texts], "t string").select(operation("t").alias("op")).collect()]
    assert got == [analyse(t)["operation"] for t in texts] == ["SELECT", "DELETE", "UPDATE", "CALL", "UNKNOWN", "UNKNOWN"]


def test_operation_ids_match_one_after_the_other(spark):
    import random

    rnd = random.Random(2)
    names = [rnd.choice(("pay", "pay2", "pay 2", "pay3", "load", "load it", "x9", "x", "only", "")) for _ in range(300)] + ["same name"] * 400
    rows = [(f"R{i:04d}", n, "validated", None) for i, n in enumerate(names)]
    rnd.shuffle(rows)
    none = spark.createDataFrame([], "entry_point_id string, kind string")
    got = {r.rule_id: r.operation_id for r in operations(spark.createDataFrame(rows, "rule_id string, name string, status string, entry_point_id string"), none).collect()}
    base = {"pay": "pay", "pay2": "pay2", "pay 2": "pay2", "pay3": "pay3", "load": "load", "load it": "loadIt", "x9": "x9", "x": "x", "only": "only", "": "rule", "same name": "sameName"}
    taken, want = set(), {}
    for rule, name, _, _ in sorted(rows):
        n, free = 2, base[name]
        while free in taken:
            free, n = f"{base[name]}{n}", n + 1
        taken.add(free)
        want[rule] = free
    assert got == want


def test_numbers_in_order(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("x"), (F.col("id") % 3).alias("y")).repartition(7)
    got = [(r.n, r.y, r.x) for r in g.numbered(df, "n", F.col("y").desc(), "x").collect()]
    want = sorted(((r.y, r.x) for r in df.collect()), key=lambda r: (-r[0], r[1]))
    assert sorted(got) == [(i, *r) for i, r in enumerate(want)]
    assert g.numbered(df.limit(0), "n", "x").count() == 0


def test_clusters_of_a_slice(spark):
    members = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "d"), ("e", "d")], "node string, root string")
    reached = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    assert {r.root for r in g.contained(members, reached).collect()} == {"a", "c"}
    nodes = spark.createDataFrame([("a",), ("z",)], "id string")
    assert {r.id: r.cluster_id for r in g.with_clusters(nodes, members).collect()} == {"a": "a", "z": None}


def test_rules_that_touch_nodes_and_review(spark):
    rules = spark.createDataFrame([("R1", "candidate", ["P1"], None), ("R2", "candidate", [], ["T1", "T2"]), ("R3", "candidate", None, [])], "rule_id string, status string, procedures array<string>, database_objects array<string>")
    assert {r.rule_id for r in rl.touches(rules, spark.createDataFrame([("P1",), ("T2",)], "id string")).collect()} == {"R1", "R2"}
    assert {r.rule_id: r.status for r in rl.promote_to_review(rules, "r2").collect()} == {"R1": "candidate", "R2": "review", "R3": "candidate"}
    with pytest.raises(LookupError):
        rl.promote_to_review(rules, "R9")
    assert rl.domain_key("FLOW-X", ["H"], []) == "HUB-H" and rl.domain_key("FLOW-X", ["H"], ["P"]) == "X" and rl.domain_key("FLOW-X", [], []) == "X"


def test_attribution_by_words_and_without(spark):
    texts = [(1, "alpha beta gamma delta"), (2, "xx beta gamma yy"), (3, "see a+b!"), (4, "")]
    needles = [("a", "pha beta gam"), ("b", "beta gamma"), ("c", "a+b"), ("d", "eta"), ("e", "nowhere to be found here"), ("f", ".. gamma ..")]
    got = model.attribute(spark.createDataFrame(needles, "k string, needle string"), spark.createDataFrame(texts, "doc long, text string"), "k", "doc")
    assert {r.k: (r.doc, r.attributed, r.n_docs) for r in got.collect()} == {"a": (1, True, 1), "b": (1, True, 2), "c": (3, True, 1), "d": (1, True, 2), "e": (1, False, 0), "f": (1, False, 0)}


def test_attribution_of_any_needle(spark):
    """Short needles, pieces of words, white space, signs, and letters of several scripts, against every text."""
    import random

    rnd = random.Random(5)
    words = ["ab", "abc", "a", "bca", "x1", "\u00e9t\u00e9", "\u4e2d\u6587", "--", "a+b", ".", "  ", "\n"]
    texts = [(i, "".join(rnd.choice(words) + rnd.choice(("", " ", "_")) for _ in range(rnd.randint(0, 12)))) for i in range(60)] + [(60, None), (61, ""), (61, "ab")]
    needles = [(f"n{i}", (t := rnd.choice(texts[:60])[1])[(a := rnd.randint(0, len(t))) : a + rnd.randint(0, 9)]) for i in range(300)]
    needles += [("none", None), ("empty", ""), ("far", "zzz"), ("farther", "ab zzz ab"), ("same", "ab"), ("same", "ab")]
    got = model.attribute(spark.createDataFrame(needles, "k string, needle string"), spark.createDataFrame(texts, "doc long, text string"), "k", "doc")
    rows = {r.k: (r.doc, r.attributed, r.n_docs) for r in got.collect()}
    for k, needle in needles:
        hits = [d for d, t in texts if needle is not None and t is not None and needle in t]
        assert rows[k] == (min(hits, default=0), bool(hits), len(hits)), needle
    assert got.count() == len(needles)
    assert not any(x in got._jdf.queryExecution().executedPlan().toString() for x in ("NestedLoopJoin LeftOuter", "CartesianProduct"))
    none = spark.createDataFrame([], "k string, needle string")
    assert model.attribute(none, spark.createDataFrame(texts, "doc long, text string"), "k", "doc").count() == 0


def test_texts_stay_where_they_are(spark, monkeypatch):
    """Needles go to the texts: no token, no pair of a text and a needle is shuffled or written. More needles meet texts by joins, with the same result."""
    texts = [(i, "the cat sat " * (i % 3) + "\U0001f600 mat" + "x" * i) for i in range(30)] + [(None, "the cat"), (31, None)]
    needles = [("a", "the"), ("b", "cat sat the"), ("c", "\U0001f600"), ("d", "t "), ("e", "x" * 29), ("f", "\U0001f600 mat"), ("g", "sat  "), ("b", "mat")]
    plans, cut = [], model.cut
    monkeypatch.setattr(model, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    monkeypatch.setattr(model, "CODED", 7)
    ask = lambda: sorted((r.k, r.doc, r.attributed, r.n_docs) for r in model.attribute(spark.createDataFrame(needles, "k string, needle string"), spark.createDataFrame(texts, "doc long, text string"), "k", "doc").collect())
    got = ask()
    hits = {k: [d for key, x in needles if key == k for d, t in texts if d is not None and t and x in t] for k, _ in needles}
    assert got == sorted((k, min(hits[k], default=0), bool(hits[k]), len(hits[k])) for k, _ in needles)
    assert len(plans) == 1 and "MapInArrow" in plans[0] and "explode" not in plans[0]
    monkeypatch.setattr(model, "GIVEN", 0)
    assert ask() == got and any("explode" in p for p in plans)


def test_keys_of_needles_are_rare_tokens(spark):
    vocabulary = spark.createDataFrame([("the", 900), ("cat", 3), ("cats", 2), (" ", 1000), ("zebra", 1)], "tok string, df long")
    named = spark.createDataFrame([("a", "x the cat y"), ("b", "at"), ("c", "the z"), ("d", "lion the king is"), ("e", "ebr")], "_k string, needle string")
    keys = {(r._1, r.tok) for r in model.token_keys(named, vocabulary).select(F.col("_k").alias("_1"), "tok").collect()}
    # an inner token that no text has leaves nothing; a piece is looked for in all tokens
    assert keys == {("a", "cat"), ("b", "cat"), ("b", "cats"), ("e", "zebra")} | {k for k in keys if k[0] == "c"}


def test_cases_and_rules_without_a_flow(spark):
    cases = spark.createDataFrame([("c1", "A", {"x": "1"}), ("c2", None, {"x": "1"}), ("c3", "", {"x": "9"}), ("c4", "any", {"x": "1"})], "case_id string, flow_id string, inputs map<string,string>")
    rules = spark.createDataFrame([("r1", "A", "x = 1", "accept"), ("r2", None, "x = 1", "reject"), ("r3", "B", "x = 1", None), ("r4", "", "y = 1", "accept")], "rule_id string, flow_id string, expression string, behavior_type string")
    got = {(r.case_id, r.rule_id): r.got for r in rl.simulate(cases, rules).collect()}
    assert got == {("c1", "r1"): "accept", ("c1", "r2"): "reject", ("c1", "r4"): "unknown", **{("c2", r): v for r, v in (("r1", "accept"), ("r2", "reject"), ("r3", "fired"), ("r4", "unknown"))}, **{("c3", r): v for r, v in (("r1", "not_fired"), ("r2", "not_fired"), ("r3", "not_fired"), ("r4", "unknown"))}, ("c4", "r2"): "reject", ("c4", "r4"): "unknown"}


def test_written_frames_can_be_deleted(spark):
    with lineage.scratch(spark) as kept:
        inner, out = lineage.cut(spark.range(3)), lineage.cut(spark.range(4))
        kept.append(out)
    exists = lambda df: spark._jvm.org.apache.hadoop.fs.Path(df._cut_path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(df._cut_path))
    assert out.count() == 4 and exists(out) and not exists(inner)
    lineage.drop(out)
    assert not exists(out)
    lineage.drop(spark.range(2))


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"
        _jsc = property(lambda s: s)
        sc = lambda s: s
        getCheckpointDir = lambda s: s
        isEmpty = lambda s: True

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.shared_dir(Session())
