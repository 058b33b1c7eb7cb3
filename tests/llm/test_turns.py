import random

import pytest
from pyspark.sql import functions as F

from storyloom.llm import turns

P = "passage_id long, scene_id long, narr_id long, scene_idx int, passage_idx int, speaker string, text string, loaded_at timestamp, sp string"
E = "example_id long, passage_id long, example_idx int, text string, line int"


def run(spark, passages, examples=(), **kw):
    p = spark.createDataFrame([(i, s, 1, 0, k, sp, t, None, "z") for i, s, k, sp, t in passages], P)
    e = spark.createDataFrame([(*x, 9) for x in examples], E)
    rows = turns.speaker_turns(p, e, **{"pause_s": 1e9, **kw}).orderBy("scene_id", "turn_no", "part_no").collect()
    return rows


def short(rows):
    return "".join(r.speaker[0] for r in rows)


@pytest.mark.parametrize("label, who", [("INT", "I"), ("Interveiwer", "I"), ("Respondant", "R"), ("THE INTERVIEWEE", "R"), ("interviewer:", "I"), ("Int. 1", "I"), (" R ", "R"), ("A", "R"), ("Q", "I"), ("", None), (None, None), ("Somebody", None), ("Befragte", "R"), ("Интервьюер", "I")])
def test_labels(spark, label, who):
    df = spark.createDataFrame([(label,)], "c string")
    assert df.select(turns.normal_label(F.col("c"))).first()[0] == who


@pytest.mark.parametrize("text, words", [("[00:12] um, (laughs)", False), ("uh [crosstalk]", False), ("\n   ", False), ("", False), ("00:12:01 - ", False), ("#00:40:28-3# *sighs*", False), ("<pause>", False), ("((inaudible))", False), ("ok", True), ("(yes, that one!)", True), ("你好", True), ("er um", False), ("[00:12] um, no", True)])
def test_words(spark, text, words):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(turns.has_words(F.col("c"))).first()[0] is words


def test_turns_of_labels_lines_and_examples(spark):
    p = [(1, 1, 0, "I", "Hello?"), (2, 1, 1, "R", None), (3, 1, 2, None, "Go on."), (4, 1, 3, "INT", "[pause]"), (5, 1, 4, "R", "Yes.\n[00:01] I: And?\nmore\nR: no"), (6, 1, 5, "", "still me")]
    e = [(11, 2, 1, "Second."), (10, 2, 0, "(12:13) First, um, yes."), (10, 2, 0, "(12:13) First, um, yes."), (12, 99, 0, "nowhere")]
    rows = run(spark, p, e)
    assert [(r.turn_no, r.speaker[0], r.text) for r in rows] == [(0, "I", "Hello?"), (1, "R", "First, yes. Second. Go on. Yes."), (2, "I", "And? more"), (3, "R", "no still me")]
    assert short(run(spark, p, e)) == "IRIR"


def test_opening_without_label(spark):
    assert short(run(spark, [(1, 1, 0, None, "Who?"), (2, 1, 1, "R", "Me.")])) == "IR"
    assert short(run(spark, [(1, 1, 0, None, "\n")], [(5, 1, 0, "I did it.")])) == "R"
    assert run(spark, []) == []


def test_repeated_passage_counts_once(spark):
    assert short(run(spark, [(1, 1, 0, "I", "a"), (2, 1, 1, "R", "b"), (1, 1, 0, "I", "a")])) == "IR"


def test_rolling_captions(spark):
    p = [(1, 1, 0, "R", "00:01 so we went down to the river"), (2, 1, 1, "R", "00:03 down to the river and swam"), (3, 1, 2, "R", "00:05 the river and swam"), (4, 1, 3, "R", "00:06 and swam until dark came")]
    for block in (1, 3, 512):
        rows = run(spark, p, block=block)
        assert [r.text for r in rows] == ["so we went down to the river and swam and swam until dark came"], block
    # another speaker's words are never a repetition, nor are untimed ones
    assert len(run(spark, [(1, 1, 0, "I", "00:01 a b c d"), (2, 1, 1, "R", "00:03 a b c d")])) == 2
    assert run(spark, [(1, 1, 0, "R", "a b c d"), (2, 1, 1, "R", "a b c d")])[0].text == "a b c d a b c d"


def test_timed_lines_come_in_the_order_of_their_marks(spark):
    rows = run(spark, [(1, 1, 0, "R", "[00:20] second\nstill second\n[00:10] first\n[00:25] I: third\nmore\n[00:05] zero")])
    assert [(r.speaker[0], r.text) for r in rows] == [("R", "first second still second"), ("I", "zero third more")]
    # labels hold from line to line, and examples keep their order, whatever their marks
    assert run(spark, [(1, 1, 0, "R", None)], [(5, 1, 0, "[00:20] one"), (6, 1, 1, "[00:10] two")])[0].text == "one two"


def test_pauses(spark):
    p = [(1, 1, 0, "R", "[00:01] a b"), (2, 1, 1, "R", "[10:00] c d")]
    assert [r.part_no for r in run(spark, p, pause_s=60.0)] == [0, 1]
    # the threshold comes from the table: gaps of about a second a word, and some of a minute
    marks, at = [], 0
    for k in range(60):
        marks.append((k + 1, 1, k, "R", f"[{at // 60:02d}:{at % 60:02d}] one two three{k}"))
        at += 60 if k % 10 == 9 else 3
    assert [r.text.count("one") for r in run(spark, marks, pause_s=None)] == [10] * 6
    assert len(run(spark, marks[:8], pause_s=None)) == 1


def model(passages):
    seq, last = [], None
    for _, _, _, label, text in sorted(passages, key=lambda x: (x[2], x[0])):
        who = {"I": "I", "R": "R"}.get(label)
        for line in (text or "").split("\n"):
            if line[:2] in ("I:", "R:"):
                who, line = line[0], line[2:]
            if line.strip(" [pause]um"):
                speaker = who or last or "I"
                last = speaker
                seq.append(speaker)
    return "".join(c for i, c in enumerate(seq) if i == 0 or c != seq[i - 1])


def test_against_sequential_model(spark):
    r = random.Random(6)
    passages = []
    for s in range(120):
        for k in range(r.randint(1, 9)):
            text = "\n".join(r.choice(["word", "I: word", "R:word", "um", "[pause]", "R:", "I: um"]) for _ in range(r.randint(1, 3)))
            passages.append((s * 100 + k, s, k, r.choice(["I", "R", None, None]), text))
    want = {s: model([p for p in passages if p[1] == s]) for s in range(120)}
    for block in (1, 2, 512):
        got = {}
        for row in run(spark, passages, block=block):
            got[row.scene_id] = got.get(row.scene_id, "") + row.speaker[0]
        assert got == {s: w for s, w in want.items() if w}
