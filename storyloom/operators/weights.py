"""Model weights attributed to words, scaled and coloured."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions.maths import COLOR_KEY, highlight
from storyloom.functions.text import ascii_words


def word_weights(docs: DataFrame, id_col: str, text_col: str, label_col: str, coefs: DataFrame, tfidf: DataFrame) -> DataFrame:
    """``(id, word_idx, word, weight)``: coefficient of the word in the class of its document times its tf-idf there.

    ``coefs`` is ``(term, label, coef)``, ``tfidf`` ``(id, term, tfidf)``. A word without either weighs 0.
    """
    rows = docs.where(F.col(text_col).isNotNull()).select(id_col, label_col, F.posexplode(ascii_words(F.col(text_col))).alias("word_idx", "word"))
    c = coefs.select(F.col("term").alias("word"), F.col("label").alias(label_col), "coef")
    t = tfidf.select(id_col, F.col("term").alias("word"), "tfidf")
    out = rows.join(t, [id_col, "word"], "left").join(c, ["word", label_col], "left")
    return out.select(id_col, "word_idx", "word", F.coalesce(F.col("coef") * F.col("tfidf"), F.lit(0.0)).alias("weight"))


def normalize_weights(df: DataFrame, col: str = "weight", strict: bool = False) -> DataFrame:
    """``normalized``: (w - min) / max, with min at most 1 and max at least -1; a max of 0 gives null or an error."""
    r = df.agg(F.least(F.lit(1.0), F.min(col)), F.greatest(F.lit(-1.0), F.max(col))).first()
    lo, hi = (1.0 if r[0] is None else r[0]), (-1.0 if r[1] is None else r[1])
    none = F.raise_error(F.lit("greatest weight is 0")) if strict else F.lit(None).cast("double")
    return df.withColumn("normalized", none if hi == 0 else (F.col(col) - F.lit(lo)) / F.lit(hi))


def colored_words(weights: DataFrame, col: str = "normalized") -> DataFrame:
    return weights.withColumn("highlight", highlight(F.col(col)))


# Terminal codes of the highlight colours.
_ANSI = {"on_green": "42", "on_cyan": "46", "on_blue": "44", "on_magenta": "45", "on_red": "41"}


def colored_text(words: DataFrame, id_col: str) -> DataFrame:
    """One terminal string a document: every word white on its colour, in order."""
    code = F.create_map(*[F.lit(x) for kv in _ANSI.items() for x in kv])
    cell = F.concat(F.lit("\x1b["), code[F.col("highlight")], F.lit("m\x1b[37m"), F.col("word"), F.lit("\x1b[0m"))
    rows = words.withColumn("cell", cell)
    return rows.groupBy(id_col).agg(F.expr("listagg(cell, ' ') within group (order by word_idx)").alias("text"))


def color_key(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, c, m) for i, (c, m) in enumerate(COLOR_KEY)], "idx int, color string, meaning string")
