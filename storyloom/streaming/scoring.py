"""File-source streams: arriving examples labelled and cut into sentences as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from storyloom.functions.text import clean_text, score_label, split_sentences


def example_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """Stream of example rows from a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def labelled_sentences(examples: DataFrame, lateness: str = "7 days") -> DataFrame:
    """``(example_id, sentence_idx, sentence, label)`` of arriving examples; an example repeated within ``lateness`` of
    its ``loaded_at`` counts once (state is dropped behind the watermark). Null texts give no row."""
    once = examples.where("text is not null").withWatermark("loaded_at", lateness).dropDuplicatesWithinWatermark(["example_id"])
    rows = once.select("example_id", score_label(F.col("score")).alias("label"), F.posexplode(split_sentences(clean_text(F.col("text")))).alias("sentence_idx", "sentence"))
    return rows.where(F.trim("sentence") != "").select("example_id", "sentence_idx", "sentence", "label")


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, exactly once by the checkpoint; runs until what is there is read."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
