"""A growing folder of books as a stream: every new file is one micro-batch row, each file is seen exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirework.operators.library import Library
from quirework.runtime import ship
from quirework.sources import epub


def follow(spark: SparkSession, folder: str, pattern: str = "*.epub", files_per_trigger: int | None = None) -> Library:
    """A library over the files that arrive in a folder; its DataFrames are streams (no aggregate needs state)."""
    reader = ship(spark).readStream.format("binaryFile").schema(epub.FILES).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return Library(epub.as_books(reader.load(folder)))


def write_chapters(library: Library, target: str, checkpoint: str, policy: str = "report", once: bool = True):
    """Append the chapters of arriving books to a Parquet table; with ``once`` all that is there now, then stop."""
    writer = library.chapters(policy).writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def chapters_of(frame: DataFrame) -> DataFrame:
    """Chapters of books that arrive by any other streaming source with the schema of binary files."""
    return Library(epub.as_books(frame)).chapters("report")
