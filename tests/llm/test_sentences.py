import pytest

from storyloom.llm import sentences as S


def cut(text):
    out, at = [], 0
    for e in S.sentence_ends(text):
        out.append(text[at:e].strip())
        at = e
    return out


@pytest.mark.parametrize(
    "text, parts",
    [
        ("", []),
        ("  \n", []),
        ("no end", ["no end"]),
        ("We met at 5 p.m. A week later he left.", ["We met at 5 p.m.", "A week later he left."]),
        ("We met at 5 p.m. sharp. Dr. Lee came.", ["We met at 5 p.m. sharp.", "Dr. Lee came."]),
        ("It cost approx. $4.50, i.e. nothing. OK?", ["It cost approx. $4.50, i.e. nothing.", "OK?"]),
        ('"Stop! Stop it!" my wife shouted. We left.', ['"Stop! Stop it!" my wife shouted.', "We left."]),
        ("“Is that all?” he asked. “Yes.” Then he left.", ["“Is that all?” he asked.", "“Yes.”", "Then he left."]),
        ("The driver (yes, that one!) left. He did.", ["The driver (yes, that one!) left.", "He did."]),
        ("I waited... and waited... Then it came.", ["I waited... and waited...", "Then it came."]),
        ("told the whole\nclass about it. So", ["told the whole\nclass about it.", "So"]),
        ("it changed me\nThe thing is, I left", ["it changed me", "The thing is, I left"]),
        ("so\nI left", ["so\nI left"]),
        ("The end.\nR: Yes. \nI: No", ["The end.", "R: Yes.", "I: No"]),
        ("我在车里哭了。“就这些吗？”我哥哥问道。好！", ["我在车里哭了。", "“就这些吗？”我哥哥问道。", "好！"]),
        ("सब बदल गया। “बस?” कोच ने पूछा।", ["सब बदल गया।", "“बस?” कोच ने पूछा।"]),
        ("«هل هذا كل شيء؟» سأل جارنا. نعم؟", ["«هل هذا كل شيء؟» سأل جارنا.", "نعم؟"]),
        ("ฉันร้องไห้ในรถ ทุกอย่างเปลี่ยนไป", ["ฉันร้องไห้ในรถ", "ทุกอย่างเปลี่ยนไป"]),
        ("Am 3. März kam er, z. B. um 8 Uhr. Ja.", ["Am 3. März kam er, z. B. um 8 Uhr.", "Ja."]),
        ("В 1964 г. мой дядя уехал и т. д. Потом вернулся.", ["В 1964 г. мой дядя уехал и т. д.", "Потом вернулся."]),
        ("¿Y? —¿Eso es todo? —preguntó mi tío. Sí.", ["¿Y?", "—¿Eso es todo? —preguntó mi tío.", "Sí."]),
        ("I said no. Then I left.", ["I said no.", "Then I left."]),
        ("Cried. [LAUGHTER]", ["Cried. [LAUGHTER]"]),
        ("It was clichÃ©d. We left.", ["It was clichÃ©d.", "We left."]),
    ],
)
def test_cases(text, parts):
    assert cut(text) == parts


def test_offsets_end_on_non_space_and_long_text():
    text = "One. Two! " * 20_000
    ends = S.sentence_ends(text)
    assert len(ends) == 40_000 and all(not text[e - 1].isspace() for e in ends)
    assert S.sentence_ends('"' * 5000) == [5000] and S.sentence_ends("(" * 5000) == [5000]


def test_table(spark):
    df = spark.createDataFrame([(1, "Ab cd. Ef gh.", 1), (1, "Ab cd. Ef gh.", 2), (2, None, 1), (3, " ", 1), (None, "x", 1), (4, "x", 1)], "id long, text string, ends int")
    got = {r.rec_id: r.ends for r in S.sentence_offsets(df, "id", "text").collect()}
    assert got == {1: [6, 13], 4: [1]}
    units = {(r.rec_id, r.sent_no, r.sentence) for r in S.sentences(df, "id", "text").collect()}
    assert units == {(1, 0, "Ab cd."), (1, 1, "Ef gh."), (4, 0, "x")}
    assert S.sentence_offsets(df.where("false"), "id", "text").count() == 0


def test_quotations_of_any_length_stay_in_their_sentence():
    for repeat in (3, 30, 300):
        inner = "We went there. " * repeat
        for opening, closing in ("“”", '""', "«»", "„“", "「」"):
            text = f"She wrote {opening}{inner.strip()}{closing} and left. I know."
            assert len(cut(text)) == 2, (opening, repeat)


@pytest.mark.parametrize(
    "text, want",
    [
        ('"she wrote (see "x. Y.") and left. I know"', ['"she wrote (see "x. Y.") and left. I know"']),
        ('He said "Go. (I had “no. Yes.” idea.) Stop." to me. Then he left.', ['He said "Go. (I had “no. Yes.” idea.) Stop." to me.', "Then he left."]),
        ("“Outer ‘in. Side.’ still.” Then more.", ["“Outer ‘in. Side.’ still.”", "Then more."]),
        ("It’s ‘so. It’s not.’ he thinks. Well.", ["It’s ‘so. It’s not.’ he thinks.", "Well."]),
        ("“It never closes. We left. We came back.", ["“It never closes.", "We left.", "We came back."]),
        ("(It never closes. “But this. Does.” anyway. Yes.", ["(It never closes.", "“But this. Does.” anyway.", "Yes."]),
        ('A 5" board. A 6" nail. Done.', ['A 5" board.', 'A 6" nail.', "Done."]),
        ("1. First item is here.\n2. Second item\n  a) inner part\n  b) more of it\n3. Third one. It goes on.", ["1. First item is here.", "2. Second item", "a) inner part", "b) more of it", "3. Third one.", "It goes on."]),
        ("We bought:\n• bread\n• milk\nThen home.", ["We bought:", "• bread", "• milk", "Then home."]),
        ("It ended in\n1987. Then we left.", ["It ended in\n1987.", "Then we left."]),
    ],
)
def test_nesting_and_lists(text, want):
    assert cut(text) == want


def test_many_openers_stay_linear():
    assert S.sentence_ends("([{" * 30_000 + "x. Y.") == [90_002, 90_005]
    assert S.sentence_ends("(" * 50_000 + "x. " + "]”" * 50_000)[-1] == 150_003
