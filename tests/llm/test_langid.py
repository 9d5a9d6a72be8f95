import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylens.llm.langid import CrossParser, identify, op3_langid, suffix_automaton, symbols, train


@given(st.lists(st.integers(2, 4), max_size=25))
@settings(max_examples=60, deadline=None)
def test_automaton_accepts_exactly_the_substrings(x):
    step = suffix_automaton(x)
    subs = {tuple(x[i:j]) for i in range(len(x) + 1) for j in range(i, len(x) + 1)}

    def walk(s, got):
        yield got
        for c, to in step[s].items():
            yield from walk(to, (*got, c))

    assert sorted(walk(0, ())) == sorted(subs)


def test_phrases_match_naive_parsing():
    rnd = random.Random(3)
    make = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    m = CrossParser({"a": [make("abcd ", 300)], "b": [make("cdef ", 300)]})
    texts = ["Abc, d!", "ccc", "fed", "", None, "abcd" * 50, "12 ;", make("abcdef ", 9000), "ab" * 6000, "a" * 5000 + "b", make("abcd", 2048), "abc" * 1500 + make("cd ", 3000), "x" * 3000]
    syms = [symbols(t, m.table) for t in texts]
    got = m.phrases(syms, m.dense)
    for g, (s, c, to) in enumerate(m.edges):
        step = [{} for _ in range(m.states[g])]
        for i, j, k in zip(s, c, to):
            step[i][j] = k
        for t, row in zip(syms, got):
            n, state = int(len(t) > 0), 0
            for x in t:
                if x in step[state]:
                    state = step[state][x]
                else:
                    n, state = n + 1, step[0].get(x, 0)
            assert row[g] == n


def test_accuracy_on_held_out_documents(spark, sf):
    sf = "/root/testdata/sf0.01"
    got = op3_langid(spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").where("held_out").collect()
    assert got.count() == truth.count()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_cases(spark):
    text = "the cat sat on the mat and "
    df = spark.createDataFrame([(1, text * 3, "en", 0.5), (2, None, "en", 0.5), (3, "", None, 0.5), (4, "12 34 !", "xx", 0.5), (5, "x" * 200_000, "en", 0.5), (None, "der hund und die katze sind", "de", 0.5), (1, text * 3, "en", 0.5)], "doc_id long, text string, lang string, score double")
    model = train(df.select("text", "lang"))
    got = identify(df, model, "doc_id").collect()
    assert len(got) == 7 and model.langs == ["de", "en"]
    by = {r.doc_id: r.lang_pred for r in got}
    assert by == {1: "en", 2: "und", 3: "und", 4: "und", 5: by[5], None: "de"}
    none = train(df.limit(0).select("text", "lang"))
    assert {r.lang_pred for r in identify(df, none, "doc_id").collect()} == {"und"}
    assert identify(df.limit(0), model, "doc_id").count() == 0


def test_large_alphabets_stay_apart():
    """Languages of one thousand letters each, beside one of few."""
    rnd = random.Random(4)
    make = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    sets = {"han": [chr(0x4E00 + i) for i in range(0, 4000, 4)], "hon": [chr(0x4E02 + i) for i in range(0, 4000, 4)], "kor": [chr(0xAC00 + i) for i in range(1000)], "lat": list("abcdefghij ")}
    m = CrossParser({k: [make(x, 600) for _ in range(40)] for k, x in sets.items()})
    dense = m.dense
    for k, x in sets.items():
        assert m.predict([make(x, 300) for _ in range(10)], dense)[0] == [k] * 10


def test_common_headings_do_not_fill_the_sample(spark):
    rnd = random.Random(5)
    head = "this heading stands above every text of the site. " * 13
    make = lambda letters: " ".join("".join(rnd.choice(letters) for _ in range(5)) for _ in range(900))
    rows = [(head + make(x), k) for k, x in (("a", "abcde"), ("b", "fghij")) for _ in range(60)]
    model = train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.predict([make("abcde"), make("fghij")], model.dense)[0] == ["a", "b"]


def test_every_part_of_a_text_can_be_sampled(spark):
    """A language whose letters stand at the end of one very long text, and a passage that stands in very many texts."""
    rnd = random.Random(6)
    make = lambda letters, n: " ".join("".join(rnd.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [("0 " * 30_000 + make("klmno", 300), "late")] + [("often " * 100, "full")] * 300 + [(make("abcde", 300), "full") for _ in range(30)]
    model = train(spark.createDataFrame(rows, "text string, lang string").repartition(7))
    again = train(spark.createDataFrame(rows[::-1], "text string, lang string").repartition(3))
    assert model.predict([make("klmno", 50), make("abcde", 50)], model.dense)[0] == ["late", "full"]
    assert [x.tolist() for e in model.edges for x in e] == [x.tolist() for e in again.edges for x in e]


def test_texts_of_no_learned_language_are_foreign():
    rnd = random.Random(7)
    words = {k: ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 8))) for _ in range(200)] for k, letters in (("a", "abcdefgh"), ("b", "efghijkl"))}
    say = lambda k, n: " ".join(rnd.choice(words[k]) for _ in range(n))
    m = CrossParser({k: [say(k, 100) for _ in range(30)] for k in words})
    noise = " ".join("".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(2, 8))) for _ in range(200))
    other = "".join(chr(rnd.randrange(0x4E00, 0x5E00)) for _ in range(300))
    texts = [say("a", 100), say("b", 100), say("a", 1), "a", noise, other, "", "1 2"]
    assert m.predict(texts, m.dense)[2] == [False] * 4 + [True, True, False, False]
