"""Text functions: Column in, Column out. ``observed`` behaviour unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Speaker tags of a transcript and whom they name.
SPEAKER_TAGS = {
    "I": "Interviewer",
    "THE INTERVIEWER": "Interviewer",
    "INTERVIEWER": "Interviewer",
    "R": "Respondent",
    "RESPONDENT": "Respondent",
    "MALE SPEAKER": "Respondent",
    "FEMALE SPEAKER": "Respondent",
    "INTERVIEWEE": "Respondent",
    "THE INTERVIEWEE": "Respondent",
    "PARTICIPANT": "Respondent",
    "ANSWER": "Respondent",
}
# Scene headings.
SCENES = ["HIGH POINT", "LOW POINT", "TURNING POINT"]
# Label of each score.
SCORE_LABELS = {0.0: -1, 1.0: -1, 1.5: 0, 2.0: 1, 3.0: 1}


def file_name(number: Column, suffix: str = "xml") -> Column:
    """``FLSA_007.xml``: zero-padded to three digits, longer numbers stay whole."""
    return F.format_string(f"FLSA_%03d.{suffix}", number.cast("long"))


def remove_parentheses(text: Column) -> Column:
    """Drop ``(...)`` up to the first ``)`` with one white space before it; an unclosed one stays."""
    return F.regexp_replace(text, r"\s?\([^)]*\)", "")


def remove_non_alphabet(text: Column) -> Column:
    """Keep ASCII letters, spaces and periods; all else goes without a space."""
    return F.regexp_replace(text, r"[^a-zA-Z .]", "")


def squeeze_spaces(text: Column) -> Column:
    """Runs of white space become one space; no trimming."""
    return F.regexp_replace(text, r"\s+", " ")


def stem_words(text: Column, stem=None) -> Column:
    """Every word with a space before it; ``stem`` maps a word Column (None: as it is)."""
    if stem is None:
        return F.concat(F.lit(" "), text)
    return F.array_join(F.transform(F.split(text, " ", -1), lambda w: F.concat(F.lit(" "), stem(w))), "")


def clean_text(text: Column, stem=None) -> Column:
    """The cleaning chain: parentheses, letters, spaces, stems, lower case."""
    return F.lower(stem_words(squeeze_spaces(remove_non_alphabet(remove_parentheses(text))), stem))


def strip_line_end(line: Column) -> Column:
    """Drop the line end and the white space before it."""
    return F.regexp_replace(line, r"\s*\n", "")


def remove_speaker(line: Column) -> Column:
    """Drop one or two words and the colon at the start of a line."""
    return F.regexp_replace(line, r"\A\w*\s*\w*:\s*", "")


def tag_of(line: Column) -> Column:
    """Text before the first colon; null without a colon."""
    return F.when(F.instr(line, ":") > 0, F.substring_index(line, ":", 1))


def speaker_of(line: Column) -> Column:
    """Interviewer or Respondent by the tag of the line (exact spelling), else null."""
    tags = F.create_map(*[F.lit(x) for kv in SPEAKER_TAGS.items() for x in kv])
    return F.try_element_at(tags, F.coalesce(tag_of(line), F.lit("")))


def is_heading(line: Column) -> Column:
    """Whether the whole line names a scene, in any case."""
    return F.coalesce(F.upper(line).isin(SCENES), F.lit(False))


def split_sentences(text: Column) -> Column:
    """Pieces between periods, with empty ones."""
    return F.split(text, "[.]", -1)


def ascii_words(text: Column) -> Column:
    """Non-empty words after dropping non-ASCII characters."""
    return F.filter(F.split(F.regexp_replace(text, r"[^\x00-\x7F]", ""), " ", -1), lambda w: w != "")


def score_label(score: Column, strict: bool = False) -> Column:
    """-1, 0 or 1; a score outside the map is null, or an error if ``strict``."""
    other = F.raise_error(F.lit("score without a label")) if strict else F.lit(None).cast("int")
    out = None
    for value, label in SCORE_LABELS.items():
        out = F.when(score == value, label) if out is None else out.when(score == value, label)
    return out.otherwise(other)


def longest_run(left: Column, right: Column) -> Column:
    """Length of the longest run of equal words both arrays share (the empty word counts).

    The longest run that ends at a word is at most one longer than the best before it, so each word of ``left`` needs a
    single substring test of the run one longer than the best, among the joined words of ``right``.
    """
    mark = F.lit("\x01")
    hay = F.when(F.size(right) > 0, F.concat(mark, F.array_join(right, "\x01"), mark)).otherwise("")

    def step(acc: Column, i: Column) -> Column:
        run = F.concat(mark, F.array_join(F.slice(left, i - acc.best, acc.best + 1), "\x01"), mark)
        return F.struct(acc.hay.alias("hay"), F.when((i > acc.best) & F.contains(acc.hay, run), acc.best + 1).otherwise(acc.best).alias("best"))

    ends = F.when(F.size(left) > 0, F.sequence(F.lit(1), F.size(left))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(ends, F.struct(hay.alias("hay"), F.lit(0).alias("best")), step, lambda acc: acc.best)


def tokens(text: Column) -> Column:
    """All matches of ``\\w*``, the empty ones too."""
    return F.regexp_extract_all(text, F.lit(r"(\w*)"), F.lit(1))


def ngrams(words: Column, n: int) -> Column:
    """1- to n-grams joined with a space."""
    def of_size(k: int) -> Column:
        starts = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))

    return F.concat(*[of_size(k) for k in range(1, n + 1)])
