"""Rules on records, each a query that returns the rows that break it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.errors import FolioscopeError
from folioscope.functions.text import is_blank


def _violations(rows: DataFrame, rule: str, detail: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys held by more than one row, with the number of rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_targets(rows: DataFrame, column: str, targets: DataFrame, key: str) -> DataFrame:
    """Distinct values of a foreign key that no target row has."""
    values = rows.select(F.col(column).alias("value")).where("value is not null").distinct()
    known = targets.select(F.col(key).alias("known"))
    return values.join(known, F.col("value") == F.col("known"), "left_anti")


def not_contiguous(rows: DataFrame, key: str) -> DataFrame:
    """One row if the ids are not exactly 0 .. n-1; no sort is needed."""
    stats = rows.agg(
        F.count(key).alias("n"), F.countDistinct(key).alias("distinct_ids"), F.min(key).alias("low"), F.max(key).alias("high")
    )
    return stats.where("n > 0 and (n <> distinct_ids or low <> 0 or high <> n - 1)")


def page_coverage(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents whose pages are not exactly 0 .. count-1."""
    held = pages.groupBy("doc_id").agg(
        F.count("*").alias("pages"),
        F.countDistinct("page_number").alias("numbers"),
        F.min("page_number").alias("low"),
        F.max("page_number").alias("high"),
    )
    told = documents.select("doc_id", F.col("page_number").alias("declared"))
    return told.join(held, "doc_id", "left").where(
        "pages is null or pages <> declared or numbers <> declared or low <> 0 or high <> declared - 1"
    )


def pages_out_of_range(pages: DataFrame, documents: DataFrame) -> DataFrame:
    told = documents.select("doc_id", F.col("page_number").alias("declared"))
    return pages.join(told, "doc_id").where("page_number < 0 or page_number >= declared")


def status_conflicts(parsed: DataFrame) -> DataFrame:
    """success needs text, empty the empty string, failed null."""
    content, status = F.col("content"), F.col("status")
    fine = (
        F.when(status == "success", content.isNotNull() & ~is_blank(content))
        .when(status == "empty", content.eqNullSafe(F.lit("")))
        .when(status == "failed", content.isNull())
        .otherwise(F.lit(False))
    )
    return parsed.where(~F.coalesce(fine, F.lit(False)) | (F.col("page_id") < 0) | is_blank(F.col("doc_id")))


def parser_output_conflicts(requested: DataFrame, output: DataFrame) -> DataFrame:
    """Requested pages without exactly one row of the same document and number, and rows nobody asked for."""
    want = requested.select("page_id", F.col("doc_id").alias("want_doc"), F.col("page_number").alias("want_number"))
    have = output.groupBy("page_id").agg(
        F.count("*").alias("rows"), F.min("doc_id").alias("have_doc"), F.min("page_number").alias("have_number")
    )
    return want.join(have, "page_id", "full_outer").where(
        "want_doc is null or have_doc is null or rows <> 1 or want_doc <> have_doc or not want_number <=> have_number"
    )


def parsed_conflicts(parsed: DataFrame) -> DataFrame:
    """Parsed rows as a whole: a page of a document twice, more than one format: ``rule, detail``."""
    formats = parsed.groupBy("content_format").agg(F.count("*").alias("n"))
    several = formats.agg(F.count("*").alias("formats")).where("formats > 1")
    return _union(
        [
            _violations(duplicates(parsed, "doc_id", "page_number"), "page twice", F.to_json(F.struct("doc_id", "page_number"))),
            _violations(several, "several formats", F.col("formats")),
        ]
    )


def span_conflicts(spans: DataFrame) -> DataFrame:
    """Spans outside their text, empty, or whose content is not the slice."""
    text, start, end = F.col("text"), F.col("start"), F.col("end")
    return spans.where(
        (F.length("content") == 0)
        | (start < 0)
        | (start >= end)
        | (end > F.length(text))
        | (F.substring(text, start + 1, end - start) != F.col("content"))
    )


def chunk_conflicts(chunks: DataFrame) -> DataFrame:
    """Chunks without id, document, content or pages, or with a page twice."""
    return chunks.where(
        "coalesce(chunk_id, '') = '' or coalesce(doc_id, '') = '' or coalesce(content, '') = '' or coalesce(size(page_ids), 0) = 0"
        " or size(array_distinct(page_ids)) <> size(page_ids)"
    )


def contributor_conflicts(retrieved: DataFrame) -> DataFrame:
    """Retrieved pages of rank below 1, without contributors, or with one that is not on the page."""
    on_page = F.forall("chunks", lambda c: F.array_contains(c["page_ids"], F.col("page_id")))
    return retrieved.where((F.col("rank") < 1) | (F.coalesce(F.size("chunks"), F.lit(0)) == 0) | ~on_page)


def run_conflicts(run: DataFrame, queries: DataFrame, pages: DataFrame) -> DataFrame:
    """Unknown queries or pages, and pages or ranks that a query has twice."""
    parts = [
        _violations(missing_targets(run, "query_id", queries, "query_id"), "unknown query", F.col("value")),
        _violations(missing_targets(run, "page_id", pages, "page_id"), "unknown page", F.col("value")),
        _violations(duplicates(run, "query_id", "page_id"), "page twice", F.to_json(F.struct("query_id", "page_id"))),
        _violations(duplicates(run, "query_id", "rank"), "rank twice", F.to_json(F.struct("query_id", "rank"))),
    ]
    return _union(parts)


def query_conflicts(queries: DataFrame) -> DataFrame:
    """Queries without id or text, and ids that come twice: ``rule, detail``."""
    parts = [
        _violations(queries.where("query_id is null"), "no id", F.col("text")),
        _violations(queries.where(F.coalesce(is_blank(F.col("text")), F.lit(True))), "blank text", F.col("query_id")),
        _violations(duplicates(queries, "query_id"), "id twice", F.col("query_id")),
    ]
    return _union(parts)


def vector_conflicts(index: DataFrame, dimension: int) -> DataFrame:
    """Vectors that are missing, of another width, not finite, or zero."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return index.where(v.isNull() | (F.size(v) != dimension) | ~finite | F.forall(v, lambda x: x == 0))


def matrix_conflicts(index: DataFrame, dimension: int) -> DataFrame:
    """Token matrices that are missing, empty or ragged."""
    t = F.col("tokens")
    return index.where(t.isNull() | (F.size(t) == 0) | ~F.forall(t, lambda r: F.size(r) == dimension))


def collection_conflicts(pages: DataFrame, documents: DataFrame, queries: DataFrame | None, qrels: DataFrame | None) -> DataFrame:
    """All rules of a collection as one query: ``rule, detail``."""
    text = lambda *c: F.to_json(F.struct(*c))
    parts = [
        _violations(duplicates(documents, "doc_id"), "document twice", F.col("doc_id")),
        _violations(duplicates(documents, "file_name"), "file twice", F.col("file_name")),
        _violations(not_contiguous(pages, "page_id"), "page ids", text("n", "low", "high")),
        _violations(missing_targets(pages, "doc_id", documents, "doc_id"), "unknown document", F.col("value")),
        _violations(pages_out_of_range(pages, documents), "page number", text("doc_id", "page_number")),
        _violations(page_coverage(pages, documents), "pages of document", F.col("doc_id")),
    ]
    if queries is not None:
        parts += [
            _violations(not_contiguous(queries, "query_id"), "query ids", text("n", "low", "high")),
            _violations(queries.where(is_blank(F.col("text"))), "blank query", F.col("query_id")),
        ]
    if qrels is not None and queries is not None:
        parts += [
            _violations(missing_targets(qrels, "query_id", queries, "query_id"), "unknown query", F.col("value")),
            _violations(missing_targets(qrels, "page_id", pages, "page_id"), "unknown page", F.col("value")),
            _violations(duplicates(qrels, "query_id", "page_id"), "judged twice", text("query_id", "page_id")),
        ]
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def require(conflicts: DataFrame | Mapping[str, DataFrame], error: type[FolioscopeError], shown: int = 5) -> None:
    """Raise with a few of the offending rows, if any."""
    for name, rows in (conflicts if isinstance(conflicts, Mapping) else {"rule broken": conflicts}).items():
        found = rows.take(shown)
        if found:
            raise error(f"{name}: " + "; ".join(str(r.asDict()) for r in found))
