import duckdb

from quarrylens.llm.chat import OP7_SQL, op7_chat, rotate

COLS = ["conv_id", "speaker", "n_turns", "n_own", "rendered", "mask_spans", "n_masked_chars"]


def test_whole_table_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.execute(f"SELECT {', '.join(COLS)} FROM ({OP7_SQL})").fetchall()
    got = [tuple(r) for r in op7_chat(spark, sf).select(*COLS).collect()]
    assert sorted(got) == sorted(want) and got


def test_perspectives_and_masks(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi 😀"), (1, 2, "bob", "hello"), (1, 3, "cy", "yo"), (1, 4, "ann", "bye")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, rendered string")
    got = {r.speaker: r for r in rotate(df).collect()}
    assert set(got) == {"ann", "bob", "cy"}
    for s, r in got.items():
        own = [t for _, _, w, t in rows if w == s]
        spans = [tuple(map(int, x.split(":"))) for x in r.mask_spans.split(",")]
        assert [r.rendered[a:b] for a, b in spans] == own and r.n_masked_chars == sum(map(len, own))
    assert got["bob"].rendered.startswith("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi")


def test_edge_cases(spark):
    rows = [(1, None, None, None), (1, 0, "a", "x<|im_end|>y"), (1, 0, "a", "x<|im_end|>y"), (None, 1, " ", "q"), (3, 0, "system", "s"), (4, 0, "b", "z" * 200_000), (5, 0, "c", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.speaker): r for r in rotate(df).collect()}
    assert set(got) == {(1, "unknown"), (1, "a"), (None, "unknown"), (4, "b"), (5, "c")}
    a = got[1, "a"]
    assert a.n_turns == 3 and a.n_own == 2 and a.rendered.count("<|im_end|>") == 3
    assert got[4, "b"].n_masked_chars == 200_000 and got[5, "c"].mask_spans.split(":")[0] == got[5, "c"].mask_spans.split(":")[1]
    assert rotate(df.limit(0)).count() == 0
