"""Graded-relevance metrics of a run, all cutoffs in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.errors import EvaluationError
from folioscope.operators.checks import require, run_conflicts

FAMILIES = ("nDCG", "Recall", "Success", "RR")


def check_metrics(metrics: Sequence[str]) -> list[str]:
    """Known families without repeats, in canonical order."""
    unknown = set(metrics) - set(FAMILIES)
    if unknown or not metrics:
        raise EvaluationError(f"metrics must be among {FAMILIES}; not {sorted(unknown)}")
    return [m for m in FAMILIES if m in metrics]


def check_cutoffs(cutoffs: Sequence[Any], top_k: int | None = None) -> list[int]:
    """Positive integers without repeats, ascending, none above the run's depth."""
    if not cutoffs or any(isinstance(k, bool) or not isinstance(k, int) or k < 1 for k in cutoffs):
        raise EvaluationError("cutoffs must be positive integers")
    if top_k is not None and max(cutoffs) > top_k:
        raise EvaluationError(f"cutoff {max(cutoffs)} is above the run's top_k {top_k}")
    return sorted(set(cutoffs))


def evaluated_qrels(qrels: DataFrame, run: DataFrame) -> DataFrame:
    """Judgments of the queries that the run has; a pair judged more than once counts with its highest grade."""
    asked = run.select("query_id").distinct()
    judged = qrels.where("query_id is not null and page_id is not null and score is not null")
    return judged.join(asked, "query_id", "left_semi").groupBy("query_id", "page_id").agg(F.max("score").alias("grade"))


def require_run(run: DataFrame, queries: DataFrame, pages: DataFrame) -> None:
    """The run is not empty, names known queries and pages, and has no page or rank twice for a query."""
    if not run.take(1):
        raise EvaluationError("the run is empty")
    require({"run": run_conflicts(run, queries, pages)}, EvaluationError)


def metric_values(run: DataFrame, qrels: DataFrame, metrics: Sequence[str] = FAMILIES, cutoffs: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """``query_id, family, k, value`` of every judged query of the run.

    The run's persisted rank decides, not its scores.  Gain is the grade, grades
    below 1 are not relevant, the discount is log2(rank + 1).
    """
    families, ks = check_metrics(metrics), check_cutoffs(cutoffs)
    judged = evaluated_qrels(qrels, run)
    ideal_order = Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "page_id")
    ideal = judged.where("grade > 0").withColumn("place", F.row_number().over(ideal_order))
    places = [f"sum(case when place <= {k} then grade / log2(place + 1) end) as ideal_{k}" for k in ks]
    best = ideal.groupBy("query_id").agg(F.count("*").alias("relevant"), *map(F.expr, places))
    hits = run.select("query_id", "page_id", "rank").join(judged.where("grade > 0"), ["query_id", "page_id"])
    sums = []
    for k in ks:
        sums += [
            F.expr(f"sum(case when rank <= {k} then grade / log2(rank + 1) end) as gain_{k}"),
            F.expr(f"count_if(rank <= {k}) as hits_{k}"),
            F.expr(f"min(case when rank <= {k} then rank end) as first_{k}"),
        ]
    found = hits.groupBy("query_id").agg(*sums)
    joined = judged.select("query_id").distinct().join(best, "query_id", "left").join(found, "query_id", "left")
    value = {
        "nDCG": "case when ideal_{k} > 0 then coalesce(gain_{k}, 0D) / ideal_{k} else 0D end",
        "Recall": "case when relevant > 0 then coalesce(hits_{k}, 0) / relevant else 0D end",
        "Success": "case when hits_{k} > 0 then 1D else 0D end",
        "RR": "coalesce(1D / first_{k}, 0D)",
    }
    grid = [(f, k, i * len(ks) + j) for i, f in enumerate(families) for j, k in enumerate(ks)]
    cells = F.array(
        *[
            F.struct(F.lit(f).alias("family"), F.lit(k).alias("k"), F.expr(value[f].format(k=k)).cast("double").alias("value"), F.lit(o).alias("place"))
            for f, k, o in grid
        ]
    )
    return joined.select("query_id", F.explode(cells).alias("cell")).select("query_id", "cell.family", "cell.k", "cell.value", "cell.place")


def aggregate_metrics(values: DataFrame) -> DataFrame:
    """``family, k, value``: the mean over the evaluated queries."""
    return values.groupBy("family", "k").agg(F.avg("value").alias("value"))


def per_query(values: DataFrame) -> DataFrame:
    """``query_id, metrics``: a map from ``family@k`` in canonical order."""
    label = F.concat_ws("@", "family", "k")
    cells = F.array_sort(F.collect_list(F.struct("place", label.alias("label"), "value")))
    entries = F.transform(cells, lambda c: F.struct(c["label"], c["value"]))
    return values.groupBy("query_id").agg(F.map_from_entries(entries).alias("metrics"))


def metric_table(values: DataFrame, families: Sequence[str] = FAMILIES) -> DataFrame:
    """Cutoffs as rows, families as columns."""
    return values.groupBy("k").pivot("family", list(families)).agg(F.round(F.avg("value"), 6))


def hits(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run with the grade of each page and whether it is a hit."""
    judged = qrels.where("score is not null").groupBy("query_id", "page_id").agg(F.max("score").alias("grade"))
    return run.join(judged, ["query_id", "page_id"], "left").withColumn("hit", F.coalesce(F.col("grade") > 0, F.lit(False)))


def best_chunk_per_page(retrieved: DataFrame) -> DataFrame:
    """``query_id, page_id, chunk_id``: the contributor of lowest rank."""
    return retrieved.select(
        "query_id", "page_id", F.explode("chunks").alias("c")
    ).groupBy("query_id", "page_id").agg(F.min_by("c.chunk_id", F.struct("c.rank", "c.chunk_id")).alias("chunk_id"))


def qrels_of_document(qrels: DataFrame, pages: DataFrame, doc_id: str) -> DataFrame:
    """Judgments of one document's pages."""
    return qrels.join(pages.where(F.col("doc_id") == doc_id).select("page_id").distinct(), "page_id", "left_semi")
