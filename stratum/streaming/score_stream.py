"""Structured Streaming scorer: submissions arriving as files are scored with
the same column functions as the batch scorer (stateless, so no watermark is
needed) and appended to a parquet sink with exactly-once file commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.operators.form import FORM_IDS
from stratum.operators.scoring import score_answers

ANSWER_SCHEMA = T.StructType([T.StructField("row_id", T.LongType())] +
                             [T.StructField(f, T.StringType()) for f in FORM_IDS])


def flatten_reply(df: DataFrame) -> DataFrame:
    """Reply columns with the recommendation list rendered for file sinks."""
    return df.select("row_id", "stress_probability", "stress_level", "message",
                     F.size("recommendations").alias("n_recommendations"),
                     F.concat_ws(" | ", "recommendations").alias("recommendations_text"), "is_fallback")


def start_score_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                       available_now: bool = True, max_files_per_trigger: int = 1000):
    """Start the file-source → score → parquet-sink query; returns the StreamingQuery."""
    src = (spark.readStream.schema(ANSWER_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(source_dir))
    out = flatten_reply(score_answers(src))
    w = out.writeStream.format("parquet").option("checkpointLocation", checkpoint_dir).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start(sink_dir)
