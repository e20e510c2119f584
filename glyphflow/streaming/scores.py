"""Scores of a stream of predictions: the batch functions, a running total, and a table of scored rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphflow.functions import text


def pairs_stream(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """sample_id, reference, prediction from JSON lines that arrive in a folder."""
    return spark.readStream.schema("sample_id string, reference string, prediction string").option("maxFilesPerTrigger", files).json(path)


def running(pairs: DataFrame, normalise: Callable[[Column], Column] = text.key) -> DataFrame:
    """One row of totals, which a stream brings up to date in mode complete."""
    rows = pairs.select(normalise(F.col("reference")).alias("r"), F.coalesce(normalise(F.col("prediction")), F.lit("")).alias("p"))
    total = rows.agg(F.count("*").alias("samples"), F.count_if(F.col("r") == F.col("p")).alias("exact_matches"), F.sum(F.levenshtein("r", "p")).cast("long").alias("edit_distance"), F.sum(F.length("r")).cast("long").alias("reference_characters"))
    return total.select("*", F.try_divide("exact_matches", "samples").alias("em"), F.try_divide("edit_distance", "reference_characters").alias("cer"))


def each_batch(stream: DataFrame, batch: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run a batch function over every micro-batch; the number of the batch names its folder, so a batch that is run again overwrites itself."""

    def run(df: DataFrame, number: int) -> None:
        batch(df).write.mode("overwrite").json(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
