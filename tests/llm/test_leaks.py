import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storyloom.llm import leaks

WORDS = [f"w{i}" for i in range(400)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute(doc, item):
    size = int(len(item) * leaks.WINDOW) + leaks.SLACK
    return max((lcs(doc[s : s + size], item) for s in range(max(1, len(doc)))), default=0)


def test_words(spark):
    texts = ["Hello, WORLD! it's 3.5_a", "我在车里 ok", "Ünïcode—dash naïve", "किताब पढ़ी", "été", "", " .. "]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", leaks.words_column(F.col("t")).alias("w"))
    got = {r.k: r.w for r in df.collect()}
    assert got == {0: ["hello", "world", "it", "s", "3", "5", "a"], 1: ["我", "在", "车", "里", "ok"], 2: ["ünïcode", "dash", "naïve"], 3: ["किताब", "पढ़ी"], 4: ["été"], 5: [], 6: []}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=14), st.lists(st.integers(0, 14), max_size=60))
def test_held_is_exact(item, doc):
    own = leaks.Item(item)
    want = brute(doc, item)
    assert leaks.share_held(doc, own) == (want / len(item) if want >= own.least else 0)


def corpus(r):
    items = {i: [r.choice(WORDS) for _ in range(r.randint(20, 40))] for i in range(12)}
    docs = {}
    for d in range(150):
        words = [r.choice(WORDS[:60]) for _ in range(r.randint(0, 120))]
        if r.random() < 0.5:
            item = items[r.randrange(12)]
            k = int(len(item) * r.choice([0.3, 0.45, 0.5, 0.55, 0.7, 1.0]))
            part = item[(s := r.randint(0, len(item) - k)) : s + k]
            for _ in range(r.randint(0, 3)):
                part.insert(r.randint(0, len(part)), "alien")
            at = r.randint(0, len(words))
            words[at:at] = part
        docs[d] = words
    return items, docs


@pytest.mark.parametrize("seed", [5, 6])
def test_against_brute_force(spark, seed):
    items, docs = corpus(random.Random(seed))
    want = {(d, i) for d, words in docs.items() for i, item in items.items() if brute(words, item) * 2 >= len(item)}
    df = spark.createDataFrame([(d, " ".join(w).upper() if d % 2 else ", ".join(w), 0) for d, w in docs.items()], "doc_id long, text string, word int")
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    assert want == {(r.doc_id, r.item_id) for r in leaks.leaked_items(df, it).collect()}
    assert want == {(r.doc_id, r.item_id) for r in leaks.leaked_items(df, it, broadcast_chars=0).collect()}


def test_scripts_agree_on_both_paths(spark):
    items = [(1, "उसने किताब पढ़ी और चिट्ठी लिखी फिर वह सो गई"), (2, "เขาเดินไปตลาดแล้วซื้อปลาสองตัว"), (3, "ذهبت إلى السوق واشتريت الخبز والحليب اليوم"), (4, "Él contó su historia más difícil otra vez"), (5, "我在车里哭了很久然后回家")]
    docs = [(10 + i, f"xyz abc. {t} qrs!") for i, t in items] + [(99, "nothing of it")]
    it, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    want = {(10 + i, i, 1.0) for i, _ in items}
    assert {tuple(r) for r in leaks.leaked_items(df, it).collect()} == want
    assert {tuple(r) for r in leaks.leaked_items(df, it, broadcast_chars=0).collect()} == want


def test_a_stray_word_before_the_copy_loses_nothing():
    item = [f"x{i}" for i in range(40)]
    doc = ["x39"] + ["z"] * 5 + [w for k in range(20) for w in (item[k], "z", "z")] + ["z"] * 40
    own = leaks.Item(item)
    assert leaks.share_held(doc[1:], own) == leaks.share_held(doc, own) == 0.5


def test_edges(spark):
    it = spark.createDataFrame([(1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (2, None), (3, "..."), (None, "x")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Alpha, beta gamma; delta!"), (1, "Alpha, beta gamma; delta!"), (2, None), (3, ""), (None, "alpha beta"), (4, "delta gamma beta alpha"), (5, "zeta " * 50_000 + "alpha beta")], "doc_id long, text string")
    for chars in (None, 0):
        assert {(r.doc_id, r.item_id) for r in leaks.leaked_items(docs, it, broadcast_chars=chars).collect()} == {(1, 1), (5, 1)}
        assert leaks.leaked_items(docs.where("false"), it, broadcast_chars=chars).count() == 0
        assert leaks.leaked_items(docs, it.where("false"), broadcast_chars=chars).count() == 0
