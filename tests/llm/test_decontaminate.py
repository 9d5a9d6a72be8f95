import random
import re

from quarrylens.llm import decontaminate as dc
from quarrylens.llm.decontaminate import HEAD, NAME, NUM, UNIT, WORD, Vocabulary, leaks, op1_decontaminate, template, tokens

ITEM = "A farmer named Mary Smith has 12 apples and gives 5 apples to Bob, who walks 3.5 km home. How many apples are left for Mary Smith in the end?"


def templates(texts, vocabulary, names=True):
    return template(*tokens(texts, vocabulary), names)[:4]


def test_templates():
    _, symbol, kind, _ = templates(["The train. It saw Anna Lee go 12 km or m in two hours"], Vocabulary())
    assert HEAD in tokens(["The train"], Vocabulary())[1]
    assert kind.tolist() == [WORD, WORD, WORD, WORD, NAME, WORD, NUM, UNIT, WORD, WORD, WORD, NUM, UNIT]
    a, b = templates(["Go, to the END"], Vocabulary())[1], templates(["go to\nthe end!"], Vocabulary())[1]
    assert a.tolist() == b.tolist()


def rows(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    return {(r.doc_id, r.item_id): r for r in leaks(d, b).collect()}


def test_exact_changed_and_clean(spark, monkeypatch):
    changed = ITEM.replace("Mary Smith", "Jane Roe").replace("12", "30").replace("5 apples", "8 apples").replace("3.5", "7")
    mixed = "A farmer named Ann has 12 apples and gives 5 apples to Ann, who walks 12 km home. How many apples are left for Zed in the end?"
    docs = [(1, "intro words. " + ITEM + " more words"), (2, "x y z. " + changed.upper().replace("HOW", "How")), (3, changed), (4, "nothing of it is here at all, only words and words"), (5, None), (6, ""), (7, ITEM.lower()), (8, "w " * 50_000 + ITEM), (1, "intro words. " + ITEM + " more words"), (None, ITEM)]
    items = [(9, ITEM), (9, ITEM), (10, "too short"), (11, None), (12, "six words that stand in here")]
    for bound in (1 << 24, 0):
        monkeypatch.setattr(dc, "BROADCAST_BYTES", bound)
        got = rows(spark, docs + [(20, "look: six words that stand in here now")], items)
        assert {(1, 9), (3, 9), (7, 9), (8, 9), (None, 9), (20, 12)} <= set(got)
        assert not {4, 5, 6} & {d for d, _ in got} and not any(i in (10, 11) for _, i in got)
        assert got[3, 9].reparameterised and not got[1, 9].reparameterised and got[1, 9].coverage == 1
        assert got[3, 9].consistency == 1
    got = rows(spark, [(1, mixed)], [(9, ITEM)])
    assert all(r.consistency < 1 for r in got.values())
    assert rows(spark, [], items) == {} and rows(spark, docs, []) == {}


def plain_tokens(text):
    """(class, value) of the tokens of a text, told one by one: W a word, # a number, U a unit, N a name, . the end of a sentence."""
    out = []
    for t in re.findall(r"[0-9]+(?:[.,:][0-9]+)*|[^\W\d_]+|[.!?\n]", text or ""):
        low, last = t.lower(), out[-1][0] if out else "."
        if t in ".!?\n":
            out.append((".", t))
        elif t[0].isdigit() or low in dc.NUMBERS:
            out.append(("#", low))
        elif low in dc.UNITS and last == "#":
            out.append(("U", low))
        elif t[0].isupper() and not (len(t) > 1 and t.isupper()) and last != "." and low not in dc.UNITS:
            out.append(("N", low))
        else:
            out.append(("W", low))
    return out


def plain_windows(text, names):
    """(token number, symbols, values) of all windows of eight symbols with five words."""
    symbols, last = [], None
    for at, (kind, value) in enumerate(plain_tokens(text)):
        if kind == "N" and not names:
            kind = "W"
        if kind == "N" and last == "N":
            symbols[-1][2] += (value,)
        elif kind != ".":
            symbols.append([at, kind, (value,)])
        last = kind
    for i in range(len(symbols) - 7):
        part = symbols[i : i + 8]
        if sum(k == "W" for _, k, _ in part) >= 5:
            yield part[0][0], tuple(v if k == "W" else k for _, k, v in part), tuple(tuple(sorted(v)) for _, k, v in part if k != "W")


def largest_matching(pairs):
    to = {}
    for a, b in pairs:
        to.setdefault(a, set()).add(b)
    held = {}

    def place(a, seen):
        for b in to[a] - seen:
            seen.add(b)
            if b not in held or place(held[b], seen):
                held[b] = a
                return True
        return False

    return sum(place(a, set()) for a in to)


def test_whole_table_matches_brute_force(spark):
    """Whole documents without variants of one item in one of them, told token by token."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()
    by, total = {}, {}
    for r in items:
        both = [list(plain_windows(r.text, n)) for n in (True, False)]
        total[r.item_id] = max(map(len, both))
        for at, h, z in set(both[0] + both[1]):
            by.setdefault(h, []).append((r.item_id, at, z))
    want = set()
    for r in docs:
        hit = {}
        for _, h, z in {w for n in (True, False) for w in plain_windows(r.text, n)}:
            for item, i, other in by.get(h, ()):
                at, zs = hit.setdefault(item, (set(), set()))
                at.add(i)
                zs.update(zip(other, z))
        for item, (at, zs) in hit.items():
            fit = largest_matching(zs) / len(zs) if zs else 1
            if len(at) >= min(6, -(-total[item] // 2)) and fit >= 0.75:
                want.add((r.doc_id, item, len(at)))
    got = {(r.doc_id, r.item_id, r.n_matched) for r in op1_decontaminate(spark, sf).collect()}
    assert got == want and want


def test_largest_matching():
    rnd = random.Random(8)
    for _ in range(400):
        pairs = sorted({(rnd.randrange(6), rnd.randrange(6)) for _ in range(rnd.randint(1, 14))})
        assert dc.matched([a for a, _ in pairs], [b for _, b in pairs]) == largest_matching(pairs) / len(pairs)
    # two of four pairs fit, though both sides have three values
    assert dc.matched([1, 2, 3, 3], [7, 7, 8, 9]) == 0.5


def test_item_and_variants_in_one_document(spark):
    variant = ITEM.replace("Mary Smith", "Jane Roe").replace("Bob", "Tim").replace("12", "30").replace("5 apples", "8 apples").replace("3.5", "7")
    other = ITEM.replace("Mary Smith", "Eve").replace("Bob", "Max").replace("12", "41").replace("5 apples", "9 apples").replace("3.5", "6")
    mixed = "A farmer named Ann has 12 apples and gives 5 apples to Ann, who walks 12 km home. How many apples are left for Zed in the end?"
    docs = [(1, ITEM + " " + variant), (2, variant + " and then. " + other), (None, other + " " + ITEM + " " + variant), (4, mixed + " " + mixed)]
    got = rows(spark, docs, [(9, ITEM)])
    assert set(got) == {(1, 9), (2, 9), (None, 9)}
    assert got[1, 9].consistency == 1 and got[1, 9].coverage == 1
    assert got[2, 9].reparameterised


def test_items_dense_in_slots(spark):
    table = "3 14 27 8 95 12 7 41 66 20 5 11 13"
    maths = "Compute 3 times 14 plus 27 minus 8 over 5 with 12 and 7 or 41 then 66 and 20 less 11"
    other = "Compute 4 times 15 plus 28 minus 9 over 6 with 13 and 8 or 42 then 67 and 21 less 31"
    people = "If Anna meets Bob and Carl, Dora calls Emil, Fred, Gina and Hugo before Ida sees Jan with Karl"
    changed = "If Olga meets Pete and Quinn, Rosa calls Stan, Tina, Uwe and Vera before Will sees Xena with Yann"
    docs = [(1, "see: " + table + " end"), (2, "so. " + maths + " it is"), (3, "so. " + other + " it is"), (4, "now. " + changed), (5, "3 14 27 9 95 12 8 41 66 21 5 11 14"), (6, "9 " * 3000)]
    items = [(1, table), (2, maths), (3, people), (4, "12 km 5")]
    for share in (1, 2):
        got = rows(spark, docs * share, items)
        assert set(got) == {(1, 1), (2, 2), (3, 2), (4, 3)}
    assert got[3, 2].reparameterised and got[4, 3].reparameterised and not got[2, 2].reparameterised and not got[1, 1].reparameterised
    assert got[1, 1].coverage == got[2, 2].coverage == got[3, 2].coverage == got[4, 3].coverage == 1


def test_items_in_scripts_without_spaces_and_short_items(spark):
    han = "一个农夫有十二个苹果他把五个苹果给了朋友然后走了三公里回家他还剩下多少个苹果"
    kana = "あるひとがりんごをいつつもっていましたそしてふたつたべましたのこりはいくつですか"
    docs = [(1, "前言。" + han + "。后记"), (2, "天气很好我们去公园散步然后回家吃饭看书睡觉明天再来一次"), (3, "x " + kana), (4, "2 + 2 = 4"), (5, "so 2 + 2 = 4 it is"), (6, "Yes!"), (7, "Yes, of course"), (8, None)]
    items = [(1, han), (2, kana), (3, "2+2 = 4"), (4, "yes"), (5, "?"), (6, "")]
    for bound in (1 << 24, 0):
        dc.BROADCAST_BYTES, old = bound, dc.BROADCAST_BYTES
        got = rows(spark, docs, items)
        dc.BROADCAST_BYTES = old
        assert set(got) == {(1, 1), (3, 2), (4, 3), (6, 4)}


HEADED = [
    ("Natalia sold 48 clips in April. Natalia sold 24 clips in May. Natalia sold how many clips?", "Weng sold 50 clips in June. Weng sold 31 clips in August. Weng sold how many clips?"),
    ("Tom has 5 apples. Tom eats 3 apples. How many apples does Tom have left now?", "Anna has 9 apples. Anna eats 4 apples. How many apples does Anna have left now?"),
    ("Mary Ann bakes 12 cakes. Bob bakes 7 cakes. Together they sell 4 cakes. Mary Ann keeps the rest. How many cakes are kept?", "Lu bakes 31 cakes. Karl Otto bakes 8 cakes. Together they sell 5 cakes. Lu keeps the rest. How many cakes are kept?"),
]
SIGNS = ("12 + 30 = 42, 7 * 6 = 42, what is 42 - 12 then?", "15 + 38 = 53, 9 * 4 = 53, what is 53 - 15 then?", "15 + 38 = 53, 9 * 4 = 36, what is 51 - 11 then?")


def test_sentences_that_begin_with_names_and_arithmetic(spark):
    items = [(i, a) for i, (a, _) in enumerate(HEADED)] + [(7, SIGNS[0]), (8, "The dog ran home. The cat saw it. The end came soon after that day.")]
    docs = [(10 + i, f"Some words. {a} Others follow.") for i, (a, _) in enumerate(HEADED)] + [(20 + i, f"Some words. {b} Others follow.") for i, (_, b) in enumerate(HEADED)]
    docs += [(17, f"so: {SIGNS[0]} it is"), (27, f"so: {SIGNS[1]} it is"), (37, f"so: {SIGNS[2]} it is")]
    docs += [(40, "Tom has 5 apples and Anna has 9. Nobody eats them now. How many cakes are there in the house?"), (41, "1 + 2 = 3, 4 * 5 = 20, 6 - 7 = 8 and so on"), (42, "Weng sold 50 cars in June. Karl sold 31 houses. Weng bought how many shares?")]
    clashing = "Weng sold 50 clips in June. Karl sold 31 clips in June. Otto sold how many clips?"
    docs += [(43, f"Some words. {clashing}")]
    for bound in (1 << 24, 0):
        dc.BROADCAST_BYTES, old = bound, dc.BROADCAST_BYTES
        got = rows(spark, docs, items)
        dc.BROADCAST_BYTES = old
        want = {(10 + i, i) for i in range(3)} | {(20 + i, i) for i in range(3)} | {(17, 7), (27, 7)}
        assert set(got) == want
    assert all(got[20 + i, i].reparameterised and not got[10 + i, i].reparameterised for i in range(3)) and got[27, 7].consistency == 1
