"""Readers of the transcript, score, XML and Parquet formats. Schemas are always given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions.text import strip_line_end

XML_SCHEMA = (
    "_narrative_num STRING, scene ARRAY<STRUCT<_scene_name: STRING, _scene_agency: DOUBLE, _scene_communion: DOUBLE, _scene_score: STRING, _word_count: STRING, "
    "passage: ARRAY<STRUCT<_speaker: STRING, _VALUE: STRING, example: ARRAY<STRUCT<_dimension: STRING, _score: DOUBLE, _VALUE: STRING>>>>>>"
)


def read_transcripts(spark: SparkSession, path: str, keep_header: bool = False) -> DataFrame:
    """``(narrative_num, line_no, line)`` of ``FLSA_NNN.txt`` files: the number from the name, lines cleaned.

    Blank lines (a bare line end) go before stripping, lines of spaces stay as empty ones. The first line is dropped.
    A file is read whole, as line order is meaning; a transcript is a document of bounded size.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"FLSA_0*(\d+)\.txt$", 1).try_cast("int").alias("narrative_num"), "value")
    lines = files.where("narrative_num is not null").select("narrative_num", F.posexplode(F.regexp_extract_all("value", F.lit(r"([^\n]*\n|[^\n]+$)"), F.lit(1))).alias("line_no", "raw"))
    lines = lines.where(~F.col("raw").isin("\n", "\r", "\r\n")).withColumn("line", strip_line_end(F.col("raw"))).drop("raw")
    return lines if keep_header else lines.where("line_no > 0")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, narrative_num, high_agency, ... turning_communion)`` of the score CSV, by position, cells as text.

    The text before the first tab is split at commas (quotes have no meaning); the header is dropped.
    """
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("line_no", "line"))
    cells = text.where("line_no > 0 and line <> ''").select("line_no", F.split(F.substring_index("line", "\t", 1), ",", -1).alias("c"))
    pick = {"narrative_num": 0, "high_agency": 1, "high_communion": 2, "low_agency": 6, "low_communion": 7, "turning_agency": 11, "turning_communion": 12}
    return cells.select("line_no", *[F.get("c", F.lit(i)).alias(n) for n, i in pick.items()])


def read_narrative_xml(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Narrative trees of XML files, one row a narrative; white space of texts is kept. ``first``..``last`` is inclusive."""
    df = spark.read.format("xml").schema(XML_SCHEMA).option("rowTag", "narrative").option("ignoreSurroundingSpaces", "false").load(path)
    return in_range(df, F.col("_narrative_num").try_cast("int"), first, last)


def in_range(df: DataFrame, number, first: int | None, last: int | None) -> DataFrame:
    if first is not None:
        df = df.where(number >= first)
    return df if last is None else df.where(number <= last)


def flat_examples(narratives: DataFrame) -> DataFrame:
    """``(narrative_num, scene_idx, scene_name, scene_agency, scene_communion, passage_idx, speaker, passage_text, example_idx, dimension, score, text)``."""
    s = narratives.select(F.col("_narrative_num").alias("narrative_num"), F.posexplode_outer("scene").alias("scene_idx", "s"))
    p = s.select("narrative_num", "scene_idx", F.col("s._scene_name").alias("scene_name"), F.col("s._scene_agency").alias("scene_agency"), F.col("s._scene_communion").alias("scene_communion"), F.posexplode_outer("s.passage").alias("passage_idx", "p"))
    keep = ["narrative_num", "scene_idx", "scene_name", "scene_agency", "scene_communion", "passage_idx"]
    e = p.select(*keep, F.col("p._speaker").alias("speaker"), F.col("p._VALUE").alias("passage_text"), F.posexplode_outer("p.example").alias("example_idx", "e"))
    return e.select(*keep, "speaker", "passage_text", "example_idx", F.col("e._dimension").alias("dimension"), F.col("e._score").alias("score"), F.col("e._VALUE").alias("text"))


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned scenes written by ``write_scenes``."""
    return spark.read.parquet(path)


def missing_numbers(spark: SparkSession, found: DataFrame, first: int, last: int, number: str = "narrative_num") -> DataFrame:
    """Numbers of the range that no file was found for."""
    wanted = spark.range(first, last + 1).select(F.col("id").cast("int").alias(number))
    return wanted.join(found.select(F.col(number).cast("int").alias(number)).distinct(), number, "left_anti")
