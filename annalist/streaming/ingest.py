"""Incremental ingest by Structured Streaming: files that arrive are read once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.sources.articles import article_segments


def ingest_vault(spark: SparkSession, vault: str, out: str, checkpoint: str, doc_type: str = "presseartikel", pattern: str = "*.md", packed: bool = False) -> int:
    """Read Markdown files that earlier calls have not read, append their segments to ``out``, return how many came.

    A file is known by its base name, so one that was moved is not read again. ``packed``: the files are those of
    :func:`annalist.sources.articles.pack_vault`, each of which is read once, with all its articles.

    What is done is in the checkpoint; a call processes all that is there and ends. Exactly once: the file sink's log and the
    checkpoint agree on each batch.
    """
    stream = spark.readStream.option("recursiveFileLookup", "true").option("fileNameOnly", "true")
    if packed:
        files = stream.format("parquet").schema("path string, text string").option("pathGlobFilter", "*.parquet").load(vault)
    else:
        files = stream.format("text").schema("value string").option("wholetext", "true").option("pathGlobFilter", pattern).load(vault)
        files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    rows = article_segments(files, doc_type)
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def event_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events per window and type, with a watermark for late ones; works on streams and on tables.

    An extension: the batch form is the tumbling case of the time series.
    """
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
