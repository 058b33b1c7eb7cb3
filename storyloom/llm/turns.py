"""Speech transcripts into clean speaker turns (problem 4).

Every line of a passage is a segment. A sweep over each scene takes the segments in the order TESTDATA.md fixes
(passage_idx, then example_idx, then the stretches between the labels of a text) and, inside a stretch, by their time
marks; untimed lines stay behind the timed line before them. Rolling-caption repetition is removed by suffix-prefix overlap of consecutive timed segments. Turns end at
speaker changes, and a turn has parts that end at pauses: gaps between time marks that are long for the words spoken,
by a threshold calibrated on all gaps of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Passages that are scanned as one block of a scene; blocks are stitched by their summaries.
BLOCK = 512
#: Words that the end of a caption and the start of the next must share at least.
CAPTION_WORDS = 3
#: Least share of the variance between gaps within and between utterances for the table to have pauses.
PAUSE_SHARE = 0.8
#: Least distance between the means of the two, in doublings.
PAUSE_OCTAVES = 2

# Speaker labels, lower case, without punctuation and digits.
INTERVIEWER = [
    "i", "q", "int", "interviewer", "the interviewer", "interviewerin", "interviewers", "question", "moderator", "researcher",
    "enquêteur", "enquêtrice", "intervieweur", "intervieweuse", "entrevistador", "entrevistadora", "intervistatore", "intervistatrice",
    "интервьюер", "інтерв'юер", "采访者", "访谈者", "聞き手", "インタビュアー", "المحاور", "ผู้สัมภาษณ์", "साक्षात्कारकर्ता",
]
RESPONDENT = [
    "r", "a", "resp", "respondent", "the respondent", "interviewee", "the interviewee", "male speaker", "female speaker", "participant", "the participant", "answer", "informant", "narrator", "subject",
    "befragte", "befragter", "befragte person", "personne interrogée", "enquêté", "enquêtée", "répondant", "répondante", "participante", "entrevistado", "entrevistada", "encuestado", "encuestada", "intervistato", "intervistata",
    "респондент", "респондентка", "受访者", "回答者", "話し手", "المستجيب", "ผู้ให้สัมภาษณ์", "उत्तरदाता",
]
#: Labels that may open a line of text. One-letter and short ones count only as written here.
LINE_SHORT = {"I": "I", "Q": "I", "INT": "I", "Int": "I", "R": "R", "A": "R", "Resp": "R", "RESP": "R"}
# Hesitation sounds; the ambiguous ones are words of some language and go only before a comma.
SOUNDS = r"u+h+m*|e+r+m+|h+m{2,}|m+h+m+|m{2,}|uh-huh|euh+|ä+h+m*|ö+h+m+|э+(?:-э+)*|э+м+|хм+|えーと|えっと|あのう|嗯+|呃+"
AMBIGUOUS = r"u+m+|e+r+|a+h+|e+h+|hm|o+h+|hã|hum|hein|ben|este|ähem|ну|那个|その"
# Stems of sound notes in round brackets.
NOTES = r"laugh|chuckl|giggl|cough|sigh|cry|cries|sob|sniff|weep|inaudible|unintelligible|indistinct|pause|silence|crosstalk|overlap|noise|music|applause|whisper|breath|clear\w* throat|phone|door|gasp|groan|yawn|lacht|lachen|weint|seufzt|hustet|rires?\b|rit\b|soupir|tousse|pleure|risas?\b|llora|suspira|tose|risos|chora|смеётся|смеется|смех|плачет|вздыхает|пауза|кашляет|笑|咳|沉默|ため息|沈黙|ضحك|يضحك|หัวเราะ|हँस"

_STAMP = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3}|-\d{1,2})?"
_TIME = rf"[\[(<#]\s*{_STAMP}\s*(?:-->?\s*{_STAMP}\s*)?[\])>#]"
_LINE_TIME = rf"(?:{_TIME}|{_STAMP}(?:\s*-->?\s*{_STAMP})?(?=\s))(?:\s*[-–—](?=\s))?\s*"
_NOTE = rf"\(\([^()]*+\)\)|\((?i:[^()]{{0,40}}(?:{NOTES})[^()]{{0,40}})\)|\[(?!(?i:at|dot|@)\])[\p{{L}}][^\]\[@]*+\]|\{{[\p{{L}}][^{{}}@]*+\}}|<[\p{{L}}/][^<>@]*+>|\*[\p{{L}}][^*@]{{0,60}}\*|[♪♫][^♪♫\n]*+[♪♫]?"
_EDGE, _END = r"(?<![\p{L}\p{M}\p{N}'’-])", r"(?![\p{L}\p{M}\p{N}'’-])"
_NOISE = rf"{_TIME}|{_NOTE}|(?iu:{_EDGE}(?:{SOUNDS}){_END})"
#: For the test of words: here the ambiguous sounds count as sounds.
#: Marks and notes come before single characters, since nothing is given back.
_NO_WORDS = rf"(?:{_TIME}|{_NOTE}|{_LINE_TIME}|(?iu:{_EDGE}(?:{SOUNDS}|{AMBIGUOUS}){_END})|\s|\p{{P}}|\p{{S}})*+"


def _label_pattern() -> str:
    long = sorted({x for x in INTERVIEWER + RESPONDENT if len(x) > 4}, key=len, reverse=True)
    short = "|".join(LINE_SHORT)
    return rf"^\s*(?:{_LINE_TIME})*((?:{short})\.?(?: ?\d)?|(?iu:{'|'.join(long)})\.?(?: ?\d)?)\s*[:：]"


LABEL = _label_pattern()


def normal_label(c: Column) -> Column:
    """``I`` or ``R`` for a speaker label in any spelling (also misspelt by up to two letters), else null."""
    t = F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, r"[\[\]():.,;#*_\d]+", " ")), r"\s+", " "))
    known = F.when(t.isin(INTERVIEWER), "I").when(t.isin(RESPONDENT), "R")
    near = F.when((F.levenshtein(t, F.lit("interviewer")) <= 2) & ~t.rlike("ee$"), "I").when((F.levenshtein(t, F.lit("respondent")) <= 2) | (F.levenshtein(t, F.lit("interviewee")) <= 1) | (F.levenshtein(t, F.lit("participant")) <= 2), "R")
    return F.coalesce(known, near)


def has_words(c: Column) -> Column:
    """Whether anything but time marks, sound notes, hesitation sounds and punctuation is left."""
    return F.regexp_replace(c, "^" + _NO_WORDS, "") != ""


def clean_words(c: Column) -> Column:
    """The words of a line without label, time marks, sound notes and hesitations."""
    t = F.regexp_replace(c, LABEL, "")
    t = F.regexp_replace(t, rf"^\s*(?:{_LINE_TIME})+", "")
    t = F.regexp_replace(t, rf"(?:{_NOISE})(?:,(?=\s))?\s?", " ")
    t = F.regexp_replace(t, rf"(?iu:{_EDGE}(?:{AMBIGUOUS}|I mean|you know|like))(?:,|…|\.\.\.)\s", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+([,.;!?])", "$1"), r"\s+", " "))


def _seconds(line: Column) -> Column:
    """Seconds of the time mark a line begins with, else null."""
    m = F.regexp_extract(line, rf"^\s*[\[(<#]?\s*({_STAMP})", 1)
    p = F.split(F.regexp_replace(F.regexp_replace(m, r"-\d+$", ""), ",", "."), ":")
    return F.when(m != "", F.aggregate(p, F.lit(0.0), lambda a, x: a * 60 + F.coalesce(x.try_cast("double"), F.lit(0.0))))


def _segments(text: Column) -> Column:
    """One struct a line of the text that holds words or a label: place, raw line, label, whether it holds words."""

    def one(line: Column, i: Column) -> Column:
        tag = F.when(F.instr(line, ":") + F.instr(line, "：") > 0, F.regexp_extract(line, LABEL, 1))
        who = F.when(F.coalesce(tag, F.lit("")) != "", normal_label(tag))
        rest = F.when(who.isNotNull(), F.regexp_replace(line, LABEL, "")).otherwise(line)
        return F.struct(i.alias("line"), line.alias("raw"), who.alias("who"), has_words(rest).alias("words"))

    return F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), one), lambda s: s.who.isNotNull() | s.words)


def overlap(before: Column, words: Column) -> Column:
    """Length of the longest suffix of ``before`` that ``words`` begins with; 0 if it is shorter than ``CAPTION_WORDS``."""
    most = F.least(F.size(words), F.size(before))
    # the two ends are compared first, so that the whole is only where both agree
    fits = lambda k: (F.element_at(before, -k) == F.element_at(words, 1)) & (F.element_at(before, -1) == F.element_at(words, k)) & (F.slice(words, F.lit(1), k) == F.slice(before, -k, k))
    k = F.array_max(F.filter(F.sequence(F.lit(CAPTION_WORDS), most), fits))
    return F.when(most >= CAPTION_WORDS, F.coalesce(k, F.lit(0))).otherwise(0)


def pause_threshold(gaps: DataFrame) -> DataFrame:
    """One row with the seconds a word above which a gap is a pause (Otsu's threshold of the logarithms), or infinity.

    ``gaps`` has the column ``rate``: seconds from a time mark to the next of the same speaker over the words between. All of them are
    counted in quarter octaves (at most 81 bins); the threshold parts the counts into two classes of greatest variance
    between them. There are pauses only if that is more than ``PAUSE_SHARE`` of all variance and the means are
    ``PAUSE_OCTAVES`` doublings apart (two separate humps).
    """
    bins = gaps.where("rate > 0").select(F.greatest(F.lit(-40), F.least(F.lit(40), F.floor(F.log2("rate") * 4))).alias("b")).groupBy("b").agg(F.count("*").cast("double").alias("n"))
    up, whole = Window.orderBy("b"), Window.partitionBy()
    w = bins.select("b", F.sum("n").over(up).alias("n0"), F.sum(F.col("n") * F.col("b")).over(up).alias("s0"), F.sum("n").over(whole).alias("n"), F.sum(F.col("n") * F.col("b")).over(whole).alias("s"), F.sum(F.col("n") * F.col("b") * F.col("b")).over(whole).alias("q"))
    w = w.where("n0 < n").withColumn("apart", (F.col("s") - F.col("s0")) / (F.col("n") - F.col("n0")) - F.col("s0") / F.col("n0"))
    w = w.withColumn("between", F.col("n0") * (F.col("n") - F.col("n0")) * F.pow("apart", F.lit(2)) / F.col("n"))
    best = w.select("b", "between", "apart", (F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("all")).where((F.col("between") > PAUSE_SHARE * F.col("all")) & (F.col("apart") >= PAUSE_OCTAVES * 4)).agg(F.max_by("b", F.struct("between", -F.col("b"))).alias("b"))
    return best.select(F.coalesce(F.pow(F.lit(2.0), (F.col("b") + 1) / 4), F.lit(float("inf"))).alias("threshold"))


def speaker_turns(passages: DataFrame, examples: DataFrame, pause_s: float | None = None, block: int = BLOCK) -> DataFrame:
    """Ordered turns ``(scene_id, turn_no, part_no, speaker, text)`` of every scene, a row for each part.

    A passage's words are its own text and its examples in order. The latest row of a ``passage_id`` counts, an
    example repeated under its ``example_id`` counts once. A passage without a label continues whoever spoke last;
    one that opens its scene is the Respondent's if it has examples, else the Interviewer's. Null and wordless
    texts make no turn, rows with null ``scene_id`` none either; empty tables give none. Other columns are ignored.
    A pause is a gap of more than ``pause_s`` seconds between time marks, or by default one above ``pause_threshold``;
    a segment that only repeats the caption before it adds nothing.

    A scene is scanned in blocks of ``block`` passages by window functions; one summary row a block is scanned over
    the scene, so no task needs a whole long scene. Only the columns a query selects are carried through.
    """
    last = F.max_by(F.struct("scene_id", "passage_idx", "speaker", "text"), F.struct("loaded_at", "passage_idx", "text"))
    own = passages.where("scene_id is not null and passage_id is not null").groupBy("passage_id").agg(last.alias("p")).select("passage_id", "p.*")
    own = own.withColumns({"blk": F.floor(F.coalesce("passage_idx", F.lit(0)) / block), "label": normal_label(F.col("speaker"))})
    meta = own.select("passage_id", "scene_id", "blk", F.coalesce("passage_idx", F.lit(0)).alias("passage_idx"), "label")
    from_own = own.where("text is not null").select("passage_id", F.lit(-1).alias("example_idx"), F.lit(-1).cast("long").alias("example_id"), F.inline(_segments(F.col("text"))))
    tagged = examples.where("text is not null and passage_id is not null").select("passage_id", F.coalesce("example_idx", F.lit(0)).alias("example_idx"), F.coalesce("example_id", F.lit(-1)).alias("example_id"), F.inline(_segments(F.col("text"))))
    # one row a line, its words cleaned once: those of a timed line as its caption, those of any other as text
    text, timed = F.when(F.col("words"), clean_words(F.col("raw"))), F.col("at_s").isNotNull()
    cut = lambda df: df.withColumn("at_s", _seconds(F.col("raw"))).select("passage_id", "example_idx", "example_id", "line", "who", "words", "at_s", F.when(~timed, text).alias("text"), F.when(timed, F.split(text, " ")).alias("caption"))
    tagged = cut(tagged).repartition("passage_id").dropDuplicates(["passage_id", "example_id", "line"])
    rows = cut(from_own).unionByName(tagged).join(meta, "passage_id").repartition("scene_id", "blk")

    written = ["passage_idx", "passage_id", "example_idx", "example_id", "line"]
    swept = [*written[:-1], "stretch", "t", "line"]
    inner = Window.partitionBy("scene_id", "blk", *written[:2]).orderBy(*written[2:]).rowsBetween(Window.unboundedPreceding, 0)
    in_text = Window.partitionBy("scene_id", "blk", *written[:4]).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"sp": F.coalesce(F.last("who", ignorenulls=True).over(inner), "label"), "stretch": F.count("who").over(in_text)})
    timed = F.last(F.when(F.col("at_s").isNotNull(), F.struct("stretch", "at_s")), ignorenulls=True).over(in_text)
    rows = rows.withColumn("timed", timed).withColumn("t", F.when(F.col("timed.stretch") == F.col("stretch"), F.col("timed.at_s")).otherwise(-1.0)).drop("timed")

    whole = Window.partitionBy("scene_id", "blk").orderBy(*swept)
    before = whole.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.where("words").withColumn("sp", F.coalesce(F.last("sp", ignorenulls=True).over(before), F.lit("?")))
    new = F.when(F.lag("sp").over(whole) != F.col("sp"), 1).otherwise(0)
    rows = rows.withColumns({"new": new, "said": F.lag(F.struct("at_s", "caption")).over(whole), "heads": F.row_number().over(whole) == 1}).withColumn("run", F.sum("new").over(before))
    rate = (F.col("at_s") - F.col("said.at_s")) / F.greatest(F.size("said.caption"), F.lit(1))
    calibrated = None if pause_s is not None else pause_threshold(rows.where("new = 0").select(rate.alias("rate"))).scalar()

    # one summary row a block: its first, second and last speaker, its runs, its last segment
    blocks = rows.groupBy("scene_id", "blk").agg(
        F.max_by("sp", F.struct(-F.col("run"))).alias("first"),
        F.max(F.when(F.col("run") == 1, F.col("sp"))).alias("second"),
        F.max_by("sp", "run").alias("last"),
        F.max("run").alias("runs"),
        F.min_by(F.col("example_idx") >= 0, F.struct("passage_idx", "passage_id", "example_idx")).alias("tagged"),
        F.max_by(F.struct("at_s", "caption"), F.struct(*swept)).alias("tail"),
    )
    over = Window.partitionBy("scene_id").orderBy("blk")
    prior = F.last(F.when(F.col("last") != "?", F.col("last")), ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.first(F.when(F.col("tagged"), "R").otherwise("I")).over(over.rowsBetween(Window.unboundedPreceding, 0))
    blocks = blocks.withColumns({"prior": prior, "opens": opens, "tail": F.lag("tail").over(over)}).withColumn("prior", F.coalesce("prior", F.when(F.row_number().over(over) > 1, F.col("opens"))))
    blocks = blocks.withColumn("head", F.when(F.col("first") != "?", F.col("first")).otherwise(F.coalesce("prior", "opens")))
    melt = ((F.col("first") == "?") & (F.col("second") == F.col("head"))).cast("int")  # the unlabelled head goes on as the next run
    blocks = blocks.withColumn("melt", F.coalesce(melt, F.lit(0))).withColumn("step", F.col("runs") - F.col("melt") + F.when(F.col("prior").isNull(), 0).when(F.col("prior") == F.col("head"), 0).otherwise(1))
    blocks = blocks.withColumn("base", F.sum("step").over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("runs") + F.col("melt")).select("scene_id", "blk", "head", "melt", "base", "tail", F.col("prior") == F.col("head"))
    blocks = blocks.toDF("scene_id", "blk", "head", "melt", "base", "tail", "goes_on")

    rows = rows.join(blocks, ["scene_id", "blk"])
    turn_no = (F.col("base") + F.when(F.col("run") > 0, F.col("run") - F.col("melt")).otherwise(0)).cast("int")
    speaker = F.when(F.when(F.col("sp") == "?", F.col("head")).otherwise(F.col("sp")) == "I", "Interviewer").otherwise("Respondent")
    # the segment before, if it is of the same turn
    said = F.when(F.col("heads"), F.when(F.col("goes_on"), F.col("tail"))).when((F.col("new") == 0) | ((F.col("run") == 1) & (F.col("melt") == 1)), F.col("said"))
    rows = rows.select("scene_id", "blk", *swept, "at_s", "text", "caption", turn_no.alias("turn_no"), speaker.alias("speaker"), said.alias("said"))
    again = F.when(F.col("caption").isNotNull() & F.col("said.caption").isNotNull(), overlap(F.col("said.caption"), F.col("caption"))).otherwise(0)
    long = F.col("at_s") - F.col("said.at_s") > pause_s if pause_s is not None else rate > calibrated
    rows = rows.withColumns({"again": again, "long": long})
    part = F.sum(F.when(F.col("long"), 1).otherwise(0)).over(Window.partitionBy("scene_id", "turn_no").orderBy(*swept).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("part_no", part.cast("int")).where(F.coalesce(F.size("caption") > F.col("again"), F.lit(True)))
    kept = F.coalesce("text", F.array_join(F.slice("caption", F.col("again") + 1, F.size("caption")), " "))
    pieces = F.array_sort(F.collect_list(F.struct(*swept, kept.alias("kept"))))
    words = F.array_join(F.filter(F.transform(pieces, lambda s: s.kept), lambda s: s != ""), " ")
    return rows.groupBy("scene_id", "turn_no", "part_no", "speaker").agg(words.alias("text"))
