"""Sentences scored by the tagged example they overlap most."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions.text import longest_run, split_sentences
from storyloom.session import spread

#: Examples with so many words are matched with the popular-word rule in observed mode.
LONG_EXAMPLE = 200


def sentence_words(sentence: Column) -> Column:
    return F.split(sentence, " ", -1)


def example_words(example: Column) -> Column:
    return F.transform(F.split(example, " ", -1), lambda w: F.replace(w, F.lit("."), F.lit("")))


def popular_word_overlap(sentence: Column, example: Column) -> Column:
    """Longest run as a sequence matcher finds it that skips popular words of long examples (Arrow UDF)."""

    @F.pandas_udf(T.IntegerType())
    def run(s: pd.Series, e: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(s, e, strict=True):
            x, y = a.split(" "), [w.replace(".", "") for w in b.split(" ")]
            out.append(SequenceMatcher(None, x, y).find_longest_match(0, len(x), 0, len(y)).size)
        return pd.Series(out, dtype="int32")

    return run(sentence, example)


def overlap(sentence: Column, example: Column, observed: bool = False) -> Column:
    """Longest run of equal words; ``observed`` applies the popular-word rule to examples of 200 words and more."""
    plain = longest_run(sentence_words(sentence), example_words(example))
    if not observed:
        return plain
    return F.when(F.size(F.split(example, " ", -1)) >= LONG_EXAMPLE, popular_word_overlap(sentence, example)).otherwise(plain)


def scene_sentences(records: DataFrame) -> DataFrame:
    """``(narr_id, scene_idx, sentence_idx, sentence)``: pieces between periods that are neither empty nor one space."""
    rows = records.select("narr_id", "scene_idx", F.posexplode(split_sentences(F.col("text"))).alias("sentence_idx", "sentence"))
    return rows.where(~F.col("sentence").isin("", " "))


def sentence_rows(records: DataFrame) -> DataFrame:
    """``(narr_id, scene_idx, sentence_idx, sentence, words, examples)``: a row a sentence, next to the examples of its
    scene with their words. Words are split once, in columns of their own, not inside the overlap's loops."""
    split = F.transform("examples", lambda e: F.struct(e.text.alias("text"), e.score.alias("score"), example_words(e.text).alias("words")))
    rows = spread(records, "narr_id", "scene_idx").select("narr_id", "scene_idx", "text", split.alias("examples"))
    rows = rows.select("narr_id", "scene_idx", "examples", F.posexplode(split_sentences(F.col("text"))).alias("sentence_idx", "sentence")).where(~F.col("sentence").isin("", " "))
    return rows.select("narr_id", "scene_idx", "sentence_idx", "sentence", sentence_words(F.col("sentence")).alias("words"), "examples")


def scored_sentences(records: DataFrame, observed: bool = False) -> DataFrame:
    """``(narr_id, scene_idx, sentence_idx, sentence, score)`` of cleaned records.

    The first example that contains the sentence gives its score; else the example of longest overlap, the first on
    ties, if that is above 0; else null. The examples stay in the scene's array, so the pairs of a scene never leave
    its row: no join and no shuffle. The overlap is only computed where no example contains the sentence.
    """
    rows = sentence_rows(records)
    hit = F.filter("examples", lambda e: F.contains(e.text, F.col("sentence")))
    keyed = ["narr_id", "scene_idx", "sentence_idx", "sentence"]
    if observed:
        pairs = rows.withColumn("hit", hit).select(*keyed, "hit", F.posexplode_outer("examples").alias("k", "e"))
        pairs = pairs.withColumn("n", F.when(F.size("hit") > 0, 0).otherwise(overlap(F.col("sentence"), F.col("e.text"), True)))
        best = pairs.groupBy(*keyed).agg(F.max_by(F.struct(F.when(F.size("hit") > 0, F.get("hit", F.lit(0)).score).otherwise(F.when(F.col("n") > 0, F.col("e.score"))).alias("score")), F.struct(F.coalesce("n", F.lit(0)), -F.col("k"))).alias("b"))
        return best.select(*keyed, "b.score")
    rows = rows.select(*keyed, "words", "examples", hit.alias("hit"))
    run = F.transform("examples", lambda e, k: F.struct(longest_run(F.col("words"), e.words).alias("n"), (-k).alias("k")))
    best = rows.select(*keyed, "examples", "hit", F.when(F.size("hit") == 0, F.array_max(run)).alias("best"))
    score = F.when(F.size("hit") > 0, F.get("hit", F.lit(0)).score).otherwise(F.when(F.col("best.n") > 0, F.get("examples", -F.col("best.k")).score))
    return best.select(*keyed, score.alias("score"))
