"""Scoring on streams. Transforms are expressions without state, so they run on a stream as they are; scores are a
stream-static join and, with a watermark, a windowed aggregation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.features import FeatureSet, Transform, flatten
from tessella.models.scoring import contributions


def read(spark: SparkSession, path: str, schema: str, glob: str = "*.parquet", files_a_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def transformed(stream: FeatureSet, transform: Transform) -> FeatureSet:
    return transform(stream)


def scored(stream: FeatureSet, weights: DataFrame, ids: list[str], model_type: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """(ids, time, score) of every example; an example's features come in one row, so its score is complete when the
    watermark has passed it."""
    long = flatten(FeatureSet(stream.df.withWatermark(time, delay)), [*ids, time])
    return contributions(long, weights, model_type).groupBy(*ids, time).agg(F.sum("part").alias("score"))


def windowed_statistics(events: DataFrame, time: str, key: str, value: str, window: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Count, sum, least and largest value of every key and window; late rows within the delay are counted."""
    return (
        events.withWatermark(time, delay).groupBy(F.window(time, window, slide), key)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "total", "least", "most")
    )


def online_update(stream: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str):
    """Call ``update`` with every micro-batch, once each."""
    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
