"""Transcript lines into scenes and passages: gaps and islands over ordered lines, window functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.text import is_heading, remove_speaker, speaker_of


def scene_passages(lines: DataFrame, key: str = "narrative_num") -> DataFrame:
    """``(key, scene_idx, scene_name, passage_idx, speaker, text)`` of ``lines(key, line_no, line)``.

    A heading opens a scene, whose passage 0 is the Interviewer's (even if empty). A tagged line of the other speaker
    opens a passage; other lines go on with it after a space. Lines before the first heading belong to scene 0, except
    the Respondent's, which are dropped. Narratives without any heading and rows with null ``line`` give no row.
    One window partition is one narrative, as its lines are a sequence; narratives are independent.
    """
    by = Window.partitionBy(key).orderBy("line_no")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.where(F.col(key).isNotNull() & F.col("line").isNotNull()).select(key, "line_no", "line", is_heading(F.col("line")).alias("head"), speaker_of(F.col("line")).alias("sp"))
    rows = rows.withColumn("sp", F.when(~F.col("head"), F.col("sp"))).withColumn("raw", F.sum(F.col("head").cast("int")).over(so_far)).withColumn("heads", F.max("raw").over(Window.partitionBy(key)))
    rows = rows.where((F.col("heads") > 0) & ~((F.col("raw") == 0) & (F.coalesce("sp", F.lit("")) == "Respondent"))).withColumn("sid", F.greatest("raw", F.lit(1)))
    scene = Window.partitionBy(key, "sid").orderBy("line_no")
    before = F.coalesce(F.last("sp", ignorenulls=True).over(scene.rowsBetween(Window.unboundedPreceding, -1)), F.lit("Interviewer"))
    rows = rows.withColumn("chg", (F.col("sp").isNotNull() & (F.col("sp") != before)).cast("int")).withColumn("pid", F.sum("chg").over(scene.rowsBetween(Window.unboundedPreceding, 0)))
    piece = F.concat(F.when(F.col("chg") == 1, "").otherwise(" "), F.when(F.col("sp").isNotNull(), remove_speaker(F.col("line"))).otherwise(F.col("line")))
    rows = rows.withColumn("piece", F.when(~F.col("head"), piece))
    grouped = rows.groupBy(key, "sid", "pid").agg(
        F.expr("coalesce(listagg(piece, '') within group (order by line_no), '')").alias("text"),
        F.max(F.when(F.col("head"), F.initcap("line"))).alias("name"),
    )
    name = F.max("name").over(Window.partitionBy(key, "sid"))
    return grouped.select(key, (F.col("sid") - 1).cast("int").alias("scene_idx"), name.alias("scene_name"), F.col("pid").cast("int").alias("passage_idx"), F.when(F.col("pid") % 2 == 0, "Interviewer").otherwise("Respondent").alias("speaker"), "text")


def scene_scores(sheet: DataFrame) -> DataFrame:
    """``(narrative_num, scene_name, agency, communion)`` of the score sheet; the last line of a narrative wins.

    The cells stay text as they are. Null narratives give no row.
    """
    cols = ["high_agency", "high_communion", "low_agency", "low_communion", "turning_agency", "turning_communion"]
    last = sheet.where("narrative_num is not null").groupBy("narrative_num").agg(F.max_by(F.struct(*cols), "line_no").alias("s")).select("narrative_num", "s.*")
    stack = "stack(3, 'HIGH POINT', high_agency, high_communion, 'LOW POINT', low_agency, low_communion, 'TURNING POINT', turning_agency, turning_communion) as (scene_name, agency, communion)"
    return last.select("narrative_num", F.expr(stack))


def with_scene_scores(scenes: DataFrame, scores: DataFrame, strict: bool = False) -> DataFrame:
    """Scenes with the scores of their narrative and name (any case); ``strict`` raises where a narrative has none."""
    key = F.upper("scene_name")
    right = scores.select("narrative_num", F.col("scene_name").alias("score_scene"), "agency", "communion")
    joined = scenes.withColumn("score_scene", key).join(right, ["narrative_num", "score_scene"], "left" if strict else "inner")
    if strict:
        joined = joined.withColumn("agency", F.when(F.col("agency").isNull() & F.col("communion").isNull(), F.raise_error(F.lit("narrative without scores"))).otherwise(F.col("agency")))
    return joined.drop("score_scene")
