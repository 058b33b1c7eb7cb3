"""Respondent examples of each scene: the response records and their cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions.text import clean_text

ORDER = ["passage_idx", "example_idx", "example_id"]


def latest(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """One row a key: the one greatest in ``by`` (nulls are smallest)."""
    rest = [c for c in df.columns if c != key]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_r")).select(key, "_r.*")


def respondent_examples(examples: DataFrame, passages: DataFrame, dimension: str | None = None) -> DataFrame:
    """Examples below passages whose speaker is exactly ``Respondent``; with ``dimension`` (intended) only of that one."""
    own = passages.where("speaker = 'Respondent'").select("passage_id")
    out = examples.join(own, "passage_id", "left_semi")
    return out.where(F.col("dimension") == dimension) if dimension else out


def scene_records(scenes: DataFrame, examples: DataFrame) -> DataFrame:
    """``(narr_id, scene_idx, text, examples)`` for every scene: a space and the text of each example in order, and the
    ordered array of (text, score). A scene without examples has the text ``''`` and an empty array."""
    keys = ["narr_id", "scene_idx"]
    rows = examples.where("text is not null").groupBy(*keys).agg(
        F.expr("listagg(concat(' ', text), '') within group (order by passage_idx, example_idx, example_id)").alias("text"),
        F.array_sort(F.collect_list(F.struct(*ORDER, "text", "score"))).alias("e"),
    )
    pairs = F.transform("e", lambda x: F.struct(x.text.alias("text"), x.score.alias("score")))
    empty = F.array().cast("array<struct<text:string,score:double>>")
    out = scenes.select(*keys).where("narr_id is not null and scene_idx is not null").distinct().join(rows, keys, "left")
    return out.select(*keys, F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.when(F.col("e").isNotNull(), pairs), empty).alias("examples"))


def clean_records(records: DataFrame, stem=None, drop_blank: bool = False) -> DataFrame:
    """Scene text and example texts cleaned; ``drop_blank`` (intended) leaves out scenes whose text is blank."""
    out = records.withColumn("text", clean_text(F.col("text"), stem)).withColumn("examples", F.transform("examples", lambda x: F.struct(clean_text(x.text, stem).alias("text"), x.score.alias("score"))))
    return out.where(F.trim("text") != "") if drop_blank else out
