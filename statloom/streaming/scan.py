"""Feature files that arrive over time, scanned against one prepared null model; and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.operators import regression as rg


def stream_features(spark: SparkSession, path: str, schema: str = "feature_id string, sample_id string, value double") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path)


def scan_stream(features: DataFrame, phenotype: DataFrame, y: str, covariates: list[str], output: str, checkpoint: str):
    """A query that scans every micro-batch of whole features and writes its results under ``output`` by batch id.

    A batch that is run again overwrites its own folder, so results are kept once. Features must not be split over batches.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        rg.scan(batch, phenotype, y, covariates).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return features.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_moments(events: DataFrame, time: str, value: str, by: list[str], width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and moments of ``value`` in event-time windows, with a watermark; works on streams and on tables."""
    w = events.withWatermark(time, late) if events.isStreaming else events
    return w.groupBy(F.window(time, width).alias("w"), *by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var")).select(F.col("w.start").alias("start"), *by, "n", "mean", "var")
