"""The incremental mode: new files of a folder, and caches over unbounded input, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import decoders

_FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of a folder's files as decoders.scan() has them; each file comes once."""
    rows = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", F.coalesce(T.detect_format("path"), F.lit("text")).alias("format"), "length", F.col("modificationTime").alias("modified"), "content")


def decoded_stream(files: DataFrame) -> DataFrame:
    return decoders.decode(files)


def first_in_ttl(requests: DataFrame, key: str = "key", at: str = "ts", ttl: str = "1 hour") -> DataFrame:
    """Of requests with the same key within the time to live the first: the others are answered by it.

    State is kept for as long as the watermark needs; later than the watermark counts as new.
    """
    return requests.withWatermark(at, ttl).dropDuplicatesWithinWatermark([key])


def quality_by_window(documents: DataFrame, at: str = "modified", text_col: str = "text", window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Documents of each quality state by the time of their arrival."""
    rows = documents.withWatermark(at, late).select(at, T.quality_state(text_col).alias("state"))
    return rows.groupBy(F.window(at, window), "state").agg(F.count("*").alias("documents")).select("window.start", "window.end", "state", "documents")
