"""Folders of files as streams: what comes in is read once, cell by cell or line by line, as it arrives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folium.sources.files import READERS, read_cells, text_pages

BINARY = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, path: str, glob: str = "*", files: int = 1000) -> DataFrame:
    """A stream of the files in a folder, at most `files` of them in a step."""
    return spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).load(path)


def watch_grid(spark: SparkSession, path: str, format: str) -> DataFrame:
    """A stream of the cells of incoming files of a format."""
    return read_cells(watch(spark, path, f"*.{format}"), READERS[format])


def watch_text(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (path, page, line, text)."""
    pages = F.pandas_udf(lambda s: s.map(lambda raw: [{"page": p, "line": i, "text": t} for p, i, t in text_pages(bytes(raw))]), "array<struct<page int, line int, text string>>")
    return watch(spark, path).select("path", F.explode(pages("content")).alias("l")).select("path", "l.*")


def drain(stream: DataFrame, target: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Writes all that is there now to Parquet and stops; the next call goes on from there."""
    out = change(stream) if change else stream
    return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
