"""Writers of narrative XML and of cleaned scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def narrative_trees(passages: DataFrame, key: str = "narrative_num") -> DataFrame:
    """One row a narrative with its scenes and passages nested in order (attribute fields begin with ``_``).

    ``passages`` is ``(key, scene_idx, scene_name[, agency, communion], passage_idx, speaker, text)``.
    """
    agency = F.col("agency").try_cast("double") if "agency" in passages.columns else F.lit(None).cast("double")
    communion = F.col("communion").try_cast("double") if "communion" in passages.columns else F.lit(None).cast("double")
    p = F.struct("passage_idx", F.struct(F.col("speaker").alias("_speaker"), F.col("text").alias("_VALUE")).alias("p"))
    scenes = passages.groupBy(key, "scene_idx").agg(F.first("scene_name").alias("n"), F.first(agency).alias("a"), F.first(communion).alias("c"), F.array_sort(F.collect_list(p)).alias("ps"))
    s = F.struct("scene_idx", F.struct(F.col("n").alias("_scene_name"), F.col("a").alias("_scene_agency"), F.col("c").alias("_scene_communion"), F.transform("ps", lambda x: x.p).alias("passage")).alias("s"))
    out = scenes.groupBy(key).agg(F.array_sort(F.collect_list(s)).alias("ss"))
    return out.select(F.col(key).cast("string").alias("_narrative_num"), F.transform("ss", lambda x: x.s).alias("scene"))


def write_narrative_xml(trees: DataFrame, path: str) -> None:
    trees.write.mode("overwrite").format("xml").option("rootTag", "narratives").option("rowTag", "narrative").save(path)


def xml_column() -> Column:
    """The tree of a row of ``narrative_trees`` as an XML string."""
    return F.to_xml(F.struct("_narrative_num", "scene"), {"rowTag": "narrative"})


def write_scenes(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").parquet(path)
