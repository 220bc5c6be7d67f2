"""A smaller collection from a larger one, numbered anew."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.ranges import range_numbers


@dataclass(frozen=True)
class Subset:
    pages: DataFrame
    queries: DataFrame
    qrels: DataFrame


def _numbered(rows: DataFrame, old: str, new: str) -> DataFrame:
    """0-based numbers in the order of the old key."""
    return range_numbers(rows.select(old).distinct(), [F.col(old).asc()], new)


def select_documents(pages: DataFrame, queries: DataFrame, qrels: DataFrame, doc_ids: DataFrame) -> Subset:
    """Pages of the given documents, their judgments, the queries judged; ids count from 0 again."""
    kept = pages.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    page_ids = _numbered(kept, "page_id", "new_page")
    judged = qrels.join(kept.select("page_id").distinct(), "page_id", "left_semi").join(
        queries.select("query_id").distinct(), "query_id", "left_semi"
    )
    query_ids = _numbered(queries.join(judged.select("query_id").distinct(), "query_id", "left_semi"), "query_id", "new_query")
    return Subset(
        kept.join(page_ids, "page_id").drop("page_id").withColumnRenamed("new_page", "page_id"),
        queries.join(query_ids, "query_id").drop("query_id").withColumnRenamed("new_query", "query_id"),
        judged.join(page_ids, "page_id").join(query_ids, "query_id").select(
            F.col("new_query").alias("query_id"), F.col("new_page").alias("page_id"), "score"
        ),
    )
