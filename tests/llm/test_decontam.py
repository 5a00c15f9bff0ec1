import random
import re

from streamlearn.llm import decontam as D
from streamlearn.llm import queries as Q

ITEM = "Now Anna has 12 apples and gives 5 apples to Bob. How many apples does Anna keep if each apple weighs 80 g in total"


def found(spark, texts, items=((0, ITEM),), **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(list(items), "item_id bigint, text string")
    return {(r.doc_id, r.item_id): r.kind for r in D.contaminated(docs, bench, **how).collect()}


def test_templates_and_slots(spark):
    texts = [
        "before it. " + ITEM + ". And after.",
        "x y z. Now Mary has 31 apples and gives 9 apples to Tom. How many apples does Mary keep if each apple weighs 70 g in total",
        "Now Mary has 31 apples and gives 9 apples to Tom. How many apples does Tom keep if each apple weighs 70 g in total",
        "She has some pears and walks to the market to sell them for a good price in the afternoon",
        None,
        "",
    ]
    got = found(spark, texts)
    assert got[0, 0] == "exact" and got[1, 0] == "template"
    assert set(got) == {(0, 0), (1, 0)}  # in text 2 one value stands for two


def test_copies_dense_in_slots(spark):
    dense = "Alice Smith paid 12 dollars, Bob Jones paid 15 dollars and Carol White paid 20 dollars in Paris, France"
    items = [(0, dense), (1, "THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG AND RUNS"), (2, "A Title Case Line About Some Names And Places In Spain"), (3, "1 2 3 5 8 13"), (4, "12 13 14 15 16 17 18 19 20 21")]
    texts = ["before. " + t + ". After it" for _, t in items]
    texts.append("before. Dora Green paid 31 dollars, Emil Brown paid 47 dollars and Fred Black paid 55 dollars in Rome, Italy. After it")
    texts += ["SOME OTHER LINE IN CAPITALS THAT IS NO ITEM AT ALL", "Another Title Case Line Without Any Of Those Words", "3 4 5 6 7 8 9 10 11 22 23"]
    got = found(spark, texts, items)
    assert got == {(n, n): "exact" for n in range(5)} | {(5, 0): "template"}


def test_clashing_slots_cost_only_their_windows(spark):
    shop = "Now Anna has 12 apples and Bob has 15 pears. How many pieces of fruit do they hold together on that day"
    twice = "There are 5 apples in a box and then 5 pears in a bag. How much fruit is there in all of it"
    passage = "When Maria came home at 7 she " + " ".join(f"thing{chr(97 + i % 26)}{chr(97 + i // 2)}" for i in range(40)) + " and so Maria went out again at 7 with Peter to walk a while"
    items = [(0, shop), (1, twice), (2, passage)]
    texts = [
        "Yes. " + shop.replace("12", "7").replace("15", "7"),
        "Yes. " + twice.replace("5 apples", "6 apples").replace("5 pears", "8 pears"),
        "Yes. " + passage.replace("Maria went", "Peter went"),
        "Yes. " + passage.replace("again at 7", "again at 9"),
    ]
    assert set(found(spark, texts, items)) == {(0, 0), (1, 1), (2, 2), (3, 2)}


def test_short_items(spark, monkeypatch):
    items = [(0, "one two three four five six"), (1, "too short"), (2, None), (3, ITEM), (4, ITEM), (5, "What is 3 + 5 ?"), (6, "+ - ="), (7, "no\nway")]
    texts = ["zero one two three four five six seven", ITEM, "too short", "it is too short", "A quiz.\n What is 3 + 5?\nEight", "What is 3 + 5 ?", "what is 3 + 6 ?", "no way", "no way at all", "+ - ="]
    # items of less than five tokens: whole lines or texts, word for word
    want = {(0, 0), (1, 3), (1, 4), (2, 1), (4, 5), (5, 5), (7, 7)}
    assert set(found(spark, texts, items)) == want
    monkeypatch.setattr(D, "BROADCAST_CHARS", 30)
    assert set(found(spark, texts, items)) == want


def test_names_where_sentences_begin(spark):
    items = [(0, "Anna bought 7 apples for 2 dollars"), (1, "Maria picked 12 red roses for her mother"), (2, "On Monday Anna Lee paid 30 euros for a small lamp and a chair"), (3, "The train left at 9 from the old station in town")]
    texts = ["Tom bought 5 apples for 3 dollars", "Yesterday Sofia picked 15 red roses for her mother", "On Friday Bob paid 45 euros for a small lamp and a chair", "On Friday Jean Paul Moreau paid 45 euros for a small lamp and a chair", "They sold 5 apples and paid for 3 pears", "A bus left at 8 from the new station by the sea"]
    got = found(spark, texts, items)
    assert got == {(0, 0): "template", (1, 1): "template", (2, 2): "template", (3, 2): "template"}


def plain_views(text):
    """Tokens (template, value) of both views, by a loop."""
    out, before = ([], []), "mark"
    for t in re.findall(r"[.!?:;\n]|\d+(?:[.,]\d+)*|[^\W\d_]+|\w+", text):
        low = t.lower()
        if t in ".!?:;\n":
            before = "mark"
            continue
        kind = "num" if t[0].isdigit() else "unit" if low in D.UNITS.split() else "capital" if t[0].isupper() else "word"
        if kind == "unit" and before != "num":
            kind = "word"
        slot = f"<{kind}>" if kind in ("num", "unit") else low
        out[0].append(("<name>" if kind == "capital" and before != "mark" else slot, low, kind in ("word", "capital") and not (kind == "capital" and before != "mark")))
        if kind == "capital" and before == "capital":
            out[1][-1] = ("<name>", low, False)
        else:
            out[1].append(("<name>" if kind == "capital" else slot, low, kind == "word"))
        before = kind
    return out


def plain_hits(text, item):
    """(view, offset, place) of equal windows."""
    out = set()
    for k, (x, y) in enumerate(zip(plain_views(text), plain_views(item))):
        if len(y) < 5:
            continue
        w = min(8, len(y))
        for j in range(len(y) - w + 1):
            for at in range(len(x) - w + 1):
                a, b = x[at : at + w], y[j : j + w]
                alike = [t for t, *_ in a] == [t for t, *_ in b] and sum(q for *_, q in b) >= 3
                if alike or (not k and [v for _, v, _ in a] == [v for _, v, _ in b]):
                    out.add((k, at - j, j))
    return out


def remade(rnd, item):
    names = ["Ada", "Ben", "Cleo", "Dan", "Eva", "Finn", "Gus", "Hal", "Ivy", "Jon"]
    rnd.shuffle(names)
    new = {}
    return re.sub(r"\d+|[A-Z][a-z]+", lambda m: new.setdefault(m[0], str(rnd.randrange(100, 999)) if m[0].isdigit() else names[len(new) % 10]), item)


def questions(rnd, n):
    nouns, verbs = "apples pears roses books coins tickets boxes shells".split(), "buys sells finds loses gives counts".split()
    out = []
    for _ in range(n):
        a, b = rnd.sample(["Anna", "Bob", "Carla", "Dora"], 2)
        out.append(f"{a} {rnd.choice(verbs)} {rnd.randrange(5, 90)} {rnd.choice(nouns)} and {b} {rnd.choice(verbs)} {rnd.randrange(5, 90)} more {rnd.choice(nouns)} at the {rnd.choice(['market', 'harbour', 'school', 'fair'])}. How many {rnd.choice(nouns)} does {a} have {rnd.choice(['now', 'left', 'in all'])} if each one weighs {rnd.randrange(2, 9)} g")
    return out


def test_windows_against_plain_python():
    rnd = random.Random(4)
    asked = questions(rnd, 12) + ["one two three four five", "ONE TWO THREE FOUR FIVE SIX", "1 2 3 4 5 6 7 8 9"]
    bench = D.Benchmark(list(enumerate(asked)))
    for text in [*asked[:4], *(remade(rnd, x) for x in asked), "Intro. " + " ".join(asked[3:6]), "one two three\nfour five six"]:
        plain, folded, _ = D.Templates()([text])
        got = set()
        for k, (side, view) in enumerate(zip(bench.sides, (plain, folded))):
            for _, hit, low, high, table in side.hits(view):
                for at, x, y in zip(hit.tolist(), low.tolist(), high.tolist()):
                    got |= {(int(side.owner[j]), k, at - j + int(side.v.bounds[side.owner[j]]), j - int(side.v.bounds[side.owner[j]])) for j in table.at[x:y].tolist()}
        assert got == {(n, *h) for n, item in enumerate(asked) for h in plain_hits(text, item)}


def test_recall_of_remade_questions(spark, sf_dir, monkeypatch):
    """Questions with other numbers and names inside ordinary texts: nearly all are found, and no clean text."""
    rnd = random.Random(8)
    asked = questions(rnd, 60)
    plain = [r.text for r in Q.read(spark, sf_dir, "documents").collect() if r.text]
    texts = [*(f"{t[:200]}. {remade(rnd, x)}? {t[200:400]}" for x, t in zip(asked, plain)), *(f"{t[:200]}. {x}? {t[200:]}" for x, t in zip(asked, plain[60:])), *plain[:40], *questions(rnd, 40)]
    got = found(spark, texts, list(enumerate(asked)))
    own = {(n, n % 60) for n in range(120)}
    assert len(own & set(got)) >= 118 and all(got[n, n - 60] == "exact" for n in range(60, 120))
    assert not {n for n, _ in got if 120 <= n < 160}
    monkeypatch.setattr(D, "BROADCAST_CHARS", 30)
    assert found(spark, texts, list(enumerate(asked))) == got


def test_hash_join_gives_the_same(spark, sf_dir, odd_docs, monkeypatch):
    docs, bench = Q.read(spark, sf_dir, "documents"), Q.read(spark, sf_dir, "benchmark")
    more = bench.unionByName(spark.createDataFrame([(None, "Hello World one two shared line third"), (900, "shared line"), (900, "shared line")], "item_id bigint, text string"), allowMissingColumns=True)
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = key(D.contaminated(docs, bench)), key(D.contaminated(odd_docs, more))
    assert len(want[0]) > 2 and len(want[1]) > 2
    monkeypatch.setattr(D, "BROADCAST_CHARS", 30)
    assert (key(D.contaminated(docs, bench)), key(D.contaminated(odd_docs, more))) == want


def test_a_very_long_text(spark):
    long = "some ordinary words stand here. " * 60_000
    assert set(found(spark, [long + ITEM, long], ((0, ITEM),))) == {(0, 0)}


def test_empty(spark, empty_docs, odd_docs):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert D.contaminated(odd_docs, bench).count() == 0
    assert D.contaminated(empty_docs, spark.createDataFrame([(0, ITEM)], "item_id bigint, text string")).count() == 0


def test_query(spark, sf_dir, small_dir):
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    for d in (sf_dir, small_dir):
        docs = {r.doc_id: " " + " ".join(words(r.text)) + " " for r in Q.read(spark, d, "documents").collect()}
        items = {r.item_id: " " + " ".join(words(r.text)) + " " for r in Q.read(spark, d, "benchmark").collect() if len(words(r.text)) > 7}
        want = {(i, k) for i, t in docs.items() for k, p in items.items() if p in t}
        rows = Q.op6_decontamination(spark, d).collect()
        assert {(r.doc_id, r.item_id) for r in rows} >= want
        pieces = {k: [w for w in zip(*[p.split()[j:] for j in range(5)])] for k, p in items.items()}
        for r in rows:  # and nothing that shares no words with its item
            assert any(" " + " ".join(w) + " " in docs[r.doc_id] for w in pieces[r.item_id])


def test_removal(spark, odd_docs):
    bench = spark.createDataFrame([(0, "Hello World one two shared line third")], "item_id bigint, text string")
    left = D.without_contaminated(odd_docs, D.contaminated(odd_docs, bench))
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count() - 1
