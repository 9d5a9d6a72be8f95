"""What the driver and single tasks are given does not grow as fast as the input."""

from quarrylens.operators import graph as g
from quarrylens.operators import model as md
from quarrylens.sources import vb6


def test_pairs_are_dealt_before_they_are_held(spark):
    nodes = spark.range(4).selectExpr("id", "'K' AS kind", "'' AS label")
    edges = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (2, 2)], "source long, target long")
    got = g.degree_centrality(nodes, edges)
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert {r.id: (r.links, r.centrality) for r in got.collect()} == {0: (2, 2 / 3), 1: (2, 2 / 3), 2: (2, 2 / 3), 3: (0, 0.0)}


def test_sweeps_broadcast_nothing(spark, monkeypatch):
    plans, cut = [], g.cut
    monkeypatch.setattr(g, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    edges = spark.createDataFrame([(a, b) for a in range(4) for b in range(a)] + [(8, 9)], "source long, target long")
    got = {r.node: r.label for r in g.settle_labels(edges).collect()}
    assert len({got[v] for v in range(4)}) == 1 and got[8] == got[9] != got[0]
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)


def test_readers_look_only_for_what_is_asked(monkeypatch):
    from quarrylens.plans.vb6_queries import FORM

    text = FORM + "Declare Function GetTick Lib \"k\" () As Long\nSub Late()\nOn Error Resume Next\nSet x = New Foo\nSet y = x\nEnd Sub\n"
    whole = list(vb6.read_file("a/C1.frm", text))
    for only in ({"procedure"}, {"procedure", "call"}, {"state_write", "sql"}, {"component", "entry_point"}, {"variable", "assignment", "attention"}):
        assert list(vb6.read_file("a/C1.frm", text, None, frozenset(only))) == [x for x in whole if x[0] in only]
    for name in ("calls", "assignment", "state_write", "sql_string", "attention"):
        monkeypatch.setattr(vb6, name, None)
    assert [x for x in whole if x[0] == "procedure"] == list(vb6.read_file("a/C1.frm", text, None, frozenset({"procedure"})))


def test_two_words_are_not_looked_for_by_the_space_between_them(spark):
    needles = spark.createDataFrame([("a", "rare word"), ("b", "no where"), ("c", "x y z")], "_k string, needle string")
    vocabulary = spark.createDataFrame([(" ", 1000), ("rare", 2), ("unrare", 1), ("word", 9), ("x", 500), ("y", 1), ("z", 500)], "tok string, df long")
    assert {(r._k, r.tok) for r in md.token_keys(needles, vocabulary).collect()} == {("a", "rare"), ("a", "unrare"), ("c", "y")}
