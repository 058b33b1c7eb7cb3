import pytest
from pyspark.sql import functions as F

from storyloom.functions import maths, text
from storyloom.functions.stem import stem


def one(spark, fn, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(fn(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


@pytest.mark.parametrize("given, expected", [("(a (b) c) d", " c) d"), ("a (b", "a (b"), ("x (y\nz) w", "x w"), ("", "")])
def test_remove_parentheses(spark, given, expected):
    assert one(spark, text.remove_parentheses, given) == expected


@pytest.mark.parametrize("given, expected", [("I'm (laughs) fine.\nYes, really", " im fine.yes really"), ("", " "), (" ", "  "), ("\n  x\n", "  x")])
def test_clean(spark, given, expected):
    assert one(spark, text.clean_text, given) == expected


def test_null_text(spark):
    assert one(spark, text.clean_text, None) is None


def test_tokens_and_ngrams(spark):
    assert one(spark, text.tokens, "foo bar") == ["foo", "", "bar", ""]
    grams = one(spark, lambda c: text.ngrams(text.tokens(c), 2), "foo bar")
    assert grams == ["foo", "", "bar", "", "foo ", " bar", "bar "]


def test_longest_run(spark):
    from difflib import SequenceMatcher
    import random

    assert one(spark, lambda a, b: text.longest_run(F.split(a, " "), F.split(b, " ")), " foo bar", " baz qux") == 1
    r = random.Random(4)
    rows = [(" ".join(r.choices("abcde", k=r.randint(1, 9))), " ".join(r.choices("abcde", k=r.randint(1, 12)))) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", text.longest_run(F.split("a", " "), F.split("b", " ")).alias("n"))
    for row in df.collect():
        x, y = row.a.split(" "), row.b.split(" ")
        assert row.n == SequenceMatcher(None, x, y, autojunk=False).find_longest_match(0, len(x), 0, len(y)).size


@pytest.mark.parametrize("score, label", [(0.0, -1), (1.0, -1), (1.5, 0), (2.0, 1), (3.0, 1), (0.5, None), (None, None)])
def test_labels(spark, score, label):
    assert spark.createDataFrame([(score,)], "s double").select(text.score_label(F.col("s"))).first()[0] == label


def test_strict_label_raises(spark):
    with pytest.raises(Exception, match="without a label"):
        spark.createDataFrame([(0.5,)], "s double").select(text.score_label(F.col("s"), strict=True)).collect()


@pytest.mark.parametrize("weight, colour", [(-0.1, "on_green"), (0.2, "on_green"), (0.21, "on_cyan"), (1.0, "on_red"), (7.0, "on_red"), (float("nan"), "on_red")])
def test_highlight(spark, weight, colour):
    assert spark.createDataFrame([(weight,)], "w double").select(maths.highlight(F.col("w"))).first()[0] == colour


def test_sigmoid_and_softplus_do_not_overflow(spark):
    row = spark.createDataFrame([(-800.0,)], "t double").select(maths.sigmoid(F.col("t")).alias("a"), maths.softplus_neg(F.col("t")).alias("b")).first()
    assert row.a == 0.0 and row.b == 800.0


def test_file_name(spark):
    df = spark.createDataFrame([(7,), (12345,)], "n int").select(text.file_name(F.col("n")).alias("f"))
    assert [r.f for r in df.collect()] == ["FLSA_007.xml", "FLSA_12345.xml"]


def test_stem():
    # from the sample vocabulary of the published description
    pairs = "consigned consign consistency consist consolation consol constancy constanc knavish knavish kneeling kneel knightly knight knives knive happy happi generate generat skies sky dying die news news running run".split()
    assert [stem(a) for a in pairs[::2]] == pairs[1::2]
    assert stem("running.") == "running." and stem("the") == "the" and stem("a") == "a"


@pytest.mark.parametrize("line, speaker, stripped", [("R: b: c", "Respondent", "b: c"), ("R", None, "R"), ("r: x", None, "x"), ("FEMALE SPEAKER:  hi", "Respondent", "hi"), ("one two three: x", None, "one two three: x")])
def test_speaker(spark, line, speaker, stripped):
    assert one(spark, text.speaker_of, line) == speaker
    assert one(spark, text.remove_speaker, line) == stripped
