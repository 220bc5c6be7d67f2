"""Documents rebuilt from pages, and the pages a span of text lies on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable_pages(parsed: DataFrame) -> DataFrame:
    """Success pages with text; repeated rows count once."""
    return (
        parsed.where("status = 'success' and content is not null and content <> ''")
        .select("page_id", "doc_id", "page_number", "content")
        .distinct()
    )


def page_offsets(parsed: DataFrame) -> DataFrame:
    """``doc_id, page_id, page_number, start, end`` in the text of the document.

    Pages are joined by one newline that no page owns.  Only lengths go through
    the shuffle, not the texts.
    """
    lengths = (
        parsed.where("status = 'success' and content is not null and content <> ''")
        .select("doc_id", "page_id", "page_number", F.length("content").alias("n"))
        .distinct()
    )
    before = Window.partitionBy("doc_id").orderBy("page_number", "page_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0)).cast("int")
    return lengths.withColumn("start", start).select(
        "doc_id", "page_id", "page_number", "start", (F.col("start") + F.col("n")).cast("int").alias("end")
    )


def reconstruct(parsed: DataFrame) -> DataFrame:
    """``doc_id, text, page_ranges``: one row per document with usable pages."""
    grouped = usable_pages(parsed).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page_number", "page_id", "content"))).alias("pages")
    )
    ranges = F.expr(
        """transform(aggregate(pages, named_struct('at', 0, 'out', cast(array() as array<struct<page_id:bigint,start:int,end:int>>)),
             (acc, p) -> named_struct('at', acc.at + length(p.content) + 1,
               'out', concat(acc.out, array(named_struct('page_id', p.page_id, 'start', acc.at, 'end', acc.at + length(p.content))))),
             acc -> acc.out), r -> r)"""
    )
    return grouped.select(
        "doc_id",
        F.array_join(F.transform("pages", lambda p: p["content"]), "\n").alias("text"),
        ranges.alias("page_ranges"),
    )


def page_ranges(parsed: DataFrame) -> DataFrame:
    """``doc_id, page_ranges`` as :func:`reconstruct` gives them, from lengths alone."""
    place = F.struct("start", "end", "page_id")
    grouped = page_offsets(parsed).groupBy("doc_id").agg(F.array_sort(F.collect_list(place)).alias("places"))
    ranges = F.transform("places", lambda p: F.struct(p["page_id"].alias("page_id"), p["start"].alias("start"), p["end"].alias("end")))
    return grouped.select("doc_id", ranges.alias("page_ranges"))


def document_texts(parsed: DataFrame) -> DataFrame:
    """``doc_id, text`` of documents with usable pages."""
    grouped = usable_pages(parsed).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page_number", "page_id", "content"))).alias("pages")
    )
    return grouped.select("doc_id", F.array_join(F.transform("pages", lambda p: p["content"]), "\n").alias("text"))


def pages_of_span(ranges: Column, start: Column, end: Column) -> Column:
    """Ids of the pages that overlap a half-open span, in page order; row-local."""
    hit = F.filter(ranges, lambda r: (start < r["end"]) & (end > r["start"]))
    return F.transform(hit, lambda r: r["page_id"])


def overlap_join(spans: DataFrame, offsets: DataFrame) -> DataFrame:
    """Spans with the pages they overlap as rows, for spans that carry no ranges."""
    o = offsets.select("doc_id", "page_id", F.col("start").alias("page_start"), F.col("end").alias("page_end"))
    return spans.join(o, "doc_id").where("start < page_end and end > page_start")
