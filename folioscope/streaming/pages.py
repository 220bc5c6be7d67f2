"""Parsing and chunking of pages as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope import schemas
from folioscope.operators.parsing import ParsingConfig, missing_pages, parse_pages


def parsed_page_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Parsed pages from Parquet files that appear in a folder."""
    return spark.readStream.schema(schemas.PARSED_PAGE).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def parse_arrivals(
    pages: DataFrame,
    sources: Callable[[], DataFrame],
    config: ParsingConfig,
    target: str,
    checkpoint_path: str,
) -> StreamingQuery:
    """Parse pages of a stream into ``target``; pages held there already are left out.

    A repeated batch finds its pages in ``target`` and adds nothing, so a restart
    leaves every page once.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            held = spark.read.schema(schemas.PARSED_PAGE).parquet(target)
            todo = missing_pages(batch, held)
        except Exception as error:  # the first batch finds no target
            if "PATH_NOT_FOUND" not in str(error):
                raise
            todo = batch
        parse_pages(todo, sources(), config).write.mode("append").parquet(target)

    return pages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start()


def status_windows(parsed: DataFrame, time: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Pages by state in windows of arrival time; rows later than ``delay`` are dropped."""
    return (
        parsed.withWatermark(time, delay)
        .groupBy(F.window(time, width).alias("span"), "status")
        .agg(F.count("*").alias("pages"))
        .select(F.col("span.start").alias("from_time"), "status", "pages")
    )
