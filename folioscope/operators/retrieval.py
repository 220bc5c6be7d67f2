"""Pages retrieved for queries: exhaustive scoring, fan-out, aggregation, ranking.

Queries meet chunks in blocks: a block of query vectors (bounded, broadcast) is
multiplied with each Arrow batch of chunk vectors.  With max, sum and mean no
row per query and chunk ever leaves a task:

* max: each batch sends on the first ``top_k`` pages that it holds;
* sum and mean: chunks are brought together by page first (vectors, not
  scores, are shuffled), so pages have their whole score where they are cut to
  the first ``top_k`` of a partition;
* contributors: only the chunks of pages that were ranked are scored again, and
  their ranks among all chunks come from counting the better ones in a pass
  over the index.

A function over a page's contributors may look at every rank, so it alone needs
all scores of all queries as rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.errors import RetrievalError
from folioscope.functions.identity import aggregation_name
from folioscope.functions.ranges import range_numbers
from folioscope.session import checkpoint

AGGREGATIONS = ("max", "sum", "mean")
#: Candidates of late interaction that reach the pages, per query.
CANDIDATES = 500
_SCORED = "query_id long, chunk_id string, page_ids array<long>, score double"


def check_top_k(top_k: Any) -> int:
    if isinstance(top_k, bool) or not isinstance(top_k, int) or top_k < 1:
        raise RetrievalError("top_k must be a positive integer")
    return top_k


def _query_blocks(queries: DataFrame, value: str, size: int) -> Iterator[tuple[np.ndarray, list[Any]]]:
    """Blocks of (ids, values), read one block at a time."""
    ids: list[int] = []
    values: list[Any] = []
    for row in queries.select("query_id", value).orderBy("query_id").toLocalIterator():
        ids.append(row[0])
        values.append(row[1])
        if len(ids) == size:
            yield np.array(ids), values
            ids, values = [], []
    if ids:
        yield np.array(ids), values


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def score_dense(index: DataFrame, queries: DataFrame, block: int = 1_024, decimals: int | None = None) -> DataFrame:
    """``query_id, chunk_id, page_ids, score`` of every query and chunk: cosine similarity."""
    spark = index.sparkSession
    rows = index.select("chunk_id", "page_ids", "embedding")
    parts = []
    for ids, vectors in _query_blocks(queries, "embedding", block):
        shared = spark.sparkContext.broadcast((ids, _unit(np.array(vectors, dtype=np.float64))))

        def score(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, asked = shared.value
            for frame in frames:
                if not len(frame):
                    continue
                held = _unit(np.stack(frame["embedding"].to_numpy()).astype(np.float64))
                scores = held @ asked.T
                if decimals is not None:
                    scores = np.round(scores, decimals)
                if not np.isfinite(scores).all():
                    raise RetrievalError("a score is not finite")
                n = len(ids)
                yield pd.DataFrame(
                    {
                        "query_id": np.tile(ids, len(frame)),
                        "chunk_id": np.repeat(frame["chunk_id"].to_numpy(), n),
                        "page_ids": np.repeat(frame["page_ids"].to_numpy(), n),
                        "score": scores.reshape(-1),
                    }
                )

        parts.append(rows.mapInPandas(score, _SCORED))
    return _united(parts, spark, _SCORED)


_BEST = "query_id long, page_id long, score double"


def best_pages_dense(
    index: DataFrame, queries: DataFrame, top_k: int, block: int = 1_024, decimals: int | None = None, margin: float = 0.0
) -> DataFrame:
    """``query_id, page_id, score``: pages by their best chunk, without a row per query and chunk.

    A page among the first ``top_k`` of a query is among the first ``top_k`` of
    the batch that holds its best chunk, so each batch of chunks sends no more
    than these (and their ties, to ``margin``) on.
    """
    check_top_k(top_k)
    spark = index.sparkSession
    rows = index.select("page_ids", "embedding")
    parts = []
    for ids, vectors in _query_blocks(queries, "embedding", block):
        shared = spark.sparkContext.broadcast((ids, _unit(np.array(vectors, dtype=np.float64))))

        def score(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, asked = shared.value
            for frame in frames:
                sizes = frame["page_ids"].map(len).to_numpy() if len(frame) else np.zeros(0, dtype=int)
                if not sizes.sum():
                    continue
                held = _unit(np.stack(frame["embedding"].to_numpy()).astype(np.float64))
                pages = np.concatenate(frame["page_ids"].to_numpy()).astype(np.int64)
                order = np.argsort(pages, kind="stable")
                pages, chunk = pages[order], np.repeat(np.arange(len(frame)), sizes)[order]
                first = np.flatnonzero(np.diff(pages, prepend=pages[0] - 1))
                best = np.maximum.reduceat((held @ asked.T)[chunk], first, axis=0)
                if decimals is not None:
                    best = np.round(best, decimals)
                if not np.isfinite(best).all():
                    raise RetrievalError("a score is not finite")
                pages = pages[first]
                if len(pages) > top_k:
                    least = np.partition(best, len(pages) - top_k, axis=0)[len(pages) - top_k]
                    at, query = np.nonzero(best >= least - margin)
                else:
                    at, query = np.nonzero(np.ones_like(best, dtype=bool))
                yield pd.DataFrame({"query_id": ids[query], "page_id": pages[at], "score": best[at, query]})

        parts.append(rows.mapInPandas(score, _BEST))
    best = _united(parts, spark, _BEST).groupBy("query_id", "page_id").agg(F.max("score").alias("score"))
    return best


def hot_pages(fanned: DataFrame, share: int = 100) -> list[int]:
    """Pages with more than 1/``share`` of all (chunk, page) rows: fewer than ``share``."""
    counts = fanned.groupBy("page_id").count()
    total = counts.agg(F.sum("count").alias("total"))
    return [r[0] for r in counts.join(F.broadcast(total), F.col("count") * share > F.col("total")).select("page_id").collect()]


_SUMS = "query_id long, page_id long, total double, n long"


def page_sums_dense(
    index: DataFrame, queries: DataFrame, top_k: int, how: str, block: int = 1_024, decimals: int | None = None, salts: int = 64, margin: float = 0.0
) -> DataFrame:
    """``query_id, page_id, score``: pages by the sum or mean of all their chunks' scores.

    Vectors are partitioned by page, so a page's sum is whole where it is
    computed and a partition sends on no more than its first ``top_k`` pages of
    each query.  Pages with a large share of the chunks are salted; their
    partial sums are all sent on and added.
    """
    check_top_k(top_k)
    spark = index.sparkSession
    fanned = index.select(F.explode("page_ids").alias("page_id"), "chunk_id", "embedding")
    hot = hot_pages(fanned)
    is_hot = F.col("page_id").isin(hot) if hot else F.lit(False)
    salt = F.when(is_hot, F.pmod(F.xxhash64("chunk_id"), F.lit(salts))).otherwise(0)
    rows = (
        fanned.withColumn("hot", is_hot).repartition("page_id", salt).sortWithinPartitions("page_id").select("page_id", "hot", "embedding")
    )
    parts = []
    for ids, vectors in _query_blocks(queries, "embedding", block):
        shared = spark.sparkContext.broadcast((ids, _unit(np.array(vectors, dtype=np.float64))))

        def score(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, asked = shared.value
            # the page that the last batch ended in may go on in the next
            page, was_hot, total, n = None, False, np.zeros(len(ids)), 0

            def whole(pages: np.ndarray, hots: np.ndarray, totals: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
                values = totals / counts[:, None] if how == "mean" else totals
                keep = np.ones_like(values, dtype=bool)
                if len(pages) > top_k:
                    least = np.partition(values, len(pages) - top_k, axis=0)[len(pages) - top_k]
                    keep = (values >= least - margin) | hots[:, None]
                at, query = np.nonzero(keep)
                return pd.DataFrame({"query_id": ids[query], "page_id": pages[at], "total": totals[at, query], "n": counts[at]})

            for frame in frames:
                if not len(frame):
                    continue
                scores = _unit(np.stack(frame["embedding"].to_numpy()).astype(np.float64)) @ asked.T
                if decimals is not None:
                    scores = np.round(scores, decimals)
                if not np.isfinite(scores).all():
                    raise RetrievalError("a score is not finite")
                pages, hots = frame["page_id"].to_numpy(), frame["hot"].to_numpy()
                first = np.flatnonzero(np.concatenate([[True], pages[1:] != pages[:-1]]))
                totals, counts = np.add.reduceat(scores, first, axis=0), np.diff(np.append(first, len(pages)))
                if page == pages[0]:
                    totals[0] += total
                    counts[0] += n
                elif page is not None:
                    yield whole(np.array([page]), np.array([was_hot]), total[None, :], np.array([n]))
                if len(first) > 1:
                    yield whole(pages[first[:-1]], hots[first[:-1]], totals[:-1], counts[:-1])
                page, was_hot, total, n = pages[-1], hots[-1], totals[-1], counts[-1]
            if page is not None:
                yield whole(np.array([page]), np.array([was_hot]), total[None, :], np.array([n]))

        parts.append(rows.mapInPandas(score, _SUMS))
    sums = _united(parts, spark, _SUMS).groupBy("query_id", "page_id").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return sums.select("query_id", "page_id", (F.col("total") / F.col("n") if how == "mean" else F.col("total")).alias("score"))


def contributors_dense(
    index: DataFrame, queries: DataFrame, pages: DataFrame, block: int = 1_024, decimals: int = 12, most_ranked: int = 500_000
) -> DataFrame:
    """``pages`` with ``chunks``: every chunk of each ranked page with its score and its rank among all chunks.

    Only chunks of ranked pages become rows.  Equal scores (to ``decimals``)
    are ordered by chunk id.
    """
    spark = index.sparkSession
    asked_by_page = pages.groupBy("page_id").agg(F.collect_set("query_id").alias("asking"))
    held = index.select(F.explode("page_ids").alias("page_id"), "chunk_id", "page_ids", "embedding").join(asked_by_page, "page_id")
    parts = []
    for ids, vectors in _query_blocks(queries, "embedding", block):
        shared = spark.sparkContext.broadcast((ids, _unit(np.array(vectors, dtype=np.float64))))

        def score(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, asked = shared.value
            for frame in frames:
                if not len(frame):
                    continue
                scores = np.round(_unit(np.stack(frame["embedding"].to_numpy()).astype(np.float64)) @ asked.T, decimals)
                row = np.repeat(np.arange(len(frame)), frame["asking"].map(len))
                who = np.concatenate(frame["asking"].to_numpy())
                at = np.minimum(np.searchsorted(ids, who), len(ids) - 1)
                own = ids[at] == who
                row, at = row[own], at[own]
                out = frame[["page_id", "chunk_id", "page_ids"]].iloc[row].reset_index(drop=True)
                out.insert(0, "query_id", ids[at])
                out["score"] = scores[row, at]
                yield out

        parts.append(held.mapInPandas(score, "query_id long, page_id long, chunk_id string, page_ids array<long>, score double"))
    found = checkpoint(
        _united(parts, spark, "query_id long, page_id long, chunk_id string, page_ids array<long>, score double").join(
            pages.select("query_id", "page_id"), ["query_id", "page_id"], "left_semi"
        )
    )
    ranks = _ranks_among_all(index, queries, found, block, decimals, most_ranked)
    gathered = found.join(ranks, ["query_id", "chunk_id"]).groupBy("query_id", "page_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score", "page_ids"))).alias("chunks")
    )
    return pages.join(gathered, ["query_id", "page_id"])


def _ranks_among_all(index: DataFrame, queries: DataFrame, found: DataFrame, block: int, decimals: int, most: int) -> DataFrame:
    """``query_id, chunk_id, rank`` of the found chunks: one more than the number of better chunks of the index.

    At most ``most`` found chunks are broadcast at once; each block of them is
    one pass over the index.
    """
    spark = index.sparkSession
    rows = index.select("chunk_id", "embedding")
    asked = found.select("query_id", "score", "chunk_id").distinct()
    parts = []
    for ids, vectors in _query_blocks(queries, "embedding", block):
        own = asked.where(F.col("query_id").between(int(ids[0]), int(ids[-1]))).orderBy("query_id", "score", "chunk_id")
        for some in _slices(own.toLocalIterator(), most):
            places = {q: k for k, q in enumerate(ids.tolist())}
            by_query: dict[int, tuple[list[float], list[str]]] = defaultdict(lambda: ([], []))
            for q, value, chunk in some:
                by_query[places[q]][0].append(value)
                by_query[places[q]][1].append(chunk)
            columns = sorted(by_query)
            unit = _unit(np.array([vectors[c] for c in columns], dtype=np.float64))
            shared = spark.sparkContext.broadcast(([int(ids[c]) for c in columns], unit, [by_query[c] for c in columns]))

            def count(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
                names, asked, wanted = shared.value
                levels = [np.array(values) for values, _ in wanted]
                better = [np.zeros(len(v) + 1, dtype=np.int64) for v in levels]
                extra = [np.zeros(len(v) + 1, dtype=np.int64) for v in levels]
                for frame in frames:
                    if not len(frame):
                        continue
                    scores = np.round(_unit(np.stack(frame["embedding"].to_numpy()).astype(np.float64)) @ asked.T, decimals)
                    chunks = frame["chunk_id"].to_numpy()
                    for k, level in enumerate(levels):
                        # a chunk is better than all found ones of a lower score, and those of its own with a later id
                        low = np.searchsorted(level, scores[:, k], side="left")
                        tied = np.flatnonzero((low < len(level)) & (level[np.minimum(low, len(level) - 1)] == scores[:, k]))
                        better[k] += np.bincount(low, minlength=len(level) + 1)
                        for r in tied.tolist():
                            high = int(np.searchsorted(level, scores[r, k], side="right"))
                            later = bisect_right(wanted[k][1], chunks[r], int(low[r]), high)
                            extra[k][later] += 1
                            extra[k][high] -= 1
                for k, (_, ids) in enumerate(wanted):
                    # better[i] chunks beat exactly the first i found ones
                    above = np.cumsum(better[k][::-1])[::-1][1:]
                    yield pd.DataFrame({"query_id": names[k], "chunk_id": ids, "n": above + np.cumsum(extra[k])[:-1]})

            parts.append(rows.mapInPandas(count, "query_id long, chunk_id string, n long"))
    counted = _united(parts, spark, "query_id long, chunk_id string, n long")
    return counted.groupBy("query_id", "chunk_id").agg((F.sum("n") + 1).cast("int").alias("rank"))


def _slices(rows: Iterable, size: int) -> Iterator[list]:
    rows = iter(rows)
    while part := list(islice(rows, size)):
        yield part


def score_late(
    index: DataFrame, queries: DataFrame, block: int = 256, decimals: int | None = None, keep: int | None = None
) -> DataFrame:
    """Exact MaxSim of every query and chunk; with ``keep``, the first so many of each batch and their ties."""
    spark = index.sparkSession
    rows = index.select("chunk_id", "page_ids", "tokens")
    parts = []
    for ids, matrices in _query_blocks(queries, "tokens", block):
        shared = spark.sparkContext.broadcast((ids, [np.array([list(t) for t in m], dtype=np.float64) for m in matrices]))

        def score(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, asked = shared.value
            stacked = np.concatenate(asked)
            begins = np.cumsum([0, *(len(m) for m in asked)])[:-1]
            for frame in frames:
                if not len(frame):
                    continue
                scores = np.empty((len(frame), len(ids)))
                for at, tokens in enumerate(frame["tokens"]):
                    held = np.stack([np.asarray(t, dtype=np.float64) for t in tokens])
                    scores[at] = np.add.reduceat((stacked @ held.T).max(axis=1), begins)
                if decimals is not None:
                    scores = np.round(scores, decimals)
                if not np.isfinite(scores).all():
                    raise RetrievalError("a score is not finite")
                if keep is not None and len(frame) > keep:
                    row, query = np.nonzero(scores >= np.partition(scores, len(frame) - keep, axis=0)[len(frame) - keep])
                else:
                    row, query = np.nonzero(np.ones_like(scores, dtype=bool))
                out = frame[["chunk_id", "page_ids"]].iloc[row].reset_index(drop=True)
                out.insert(0, "query_id", ids[query])
                out["score"] = scores[row, query]
                yield out

        parts.append(rows.mapInPandas(score, _SCORED))
    return _united(parts, spark, _SCORED)


def _united(parts: list[DataFrame], spark, schema: str) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def rank_chunks(scored: DataFrame, limit: int | None = None) -> DataFrame:
    """Chunks with their rank by descending score, chunk id breaking ties; the first ``limit`` if given.

    Without a limit a query's chunks are ranked over ranges, so no task has all
    chunks of a query.
    """
    order = [F.col("score").desc(), F.col("chunk_id").asc()]
    if limit is None:
        return range_numbers(scored, order, "rank", within="query_id").withColumn("rank", (F.col("rank") + 1).cast("int"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= limit)


def fan_out(scored: DataFrame) -> DataFrame:
    """A chunk's full score for each of its pages."""
    return scored.withColumn("page_id", F.explode("page_ids"))


def aggregate_pages(
    scored: DataFrame,
    aggregation: str | Callable[[Column], Column] = "max",
    decimals: int | None = None,
) -> DataFrame:
    """``query_id, page_id, score``.

    ``aggregation`` is max, sum, mean, or a function from the column of the
    page's contributors (structs of rank, chunk_id, score, page_ids in rank
    order) to a column; the latter needs ranked chunks.
    """
    pages = fan_out(scored)
    if callable(aggregation):
        grouped = pages.groupBy("query_id", "page_id").agg(
            F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score", "page_ids"))).alias("chunks")
        )
        out = grouped.select("query_id", "page_id", aggregation(F.col("chunks")).cast("double").alias("score"))
    else:
        if aggregation not in AGGREGATIONS:
            raise RetrievalError(f"aggregation must be one of {AGGREGATIONS} or a function")
        how = {"max": F.max, "sum": F.sum, "mean": F.avg}[aggregation]
        out = pages.groupBy("query_id", "page_id").agg(how("score").alias("score"))
    return out if decimals is None else out.withColumn("score", F.round("score", decimals))


def aggregate_with_python(ranked: DataFrame, function: Callable[[list[dict]], float]) -> DataFrame:
    """As :func:`aggregate_pages`, with a Python function over the contributors of one page."""
    name = aggregation_name(function)

    def apply(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rank", "chunk_id"])
        records = frame[["rank", "chunk_id", "score", "page_ids"]].to_dict("records")
        try:
            value = function(records)
        except Exception as error:
            raise RetrievalError(f"aggregation {name} failed") from error
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not np.isfinite(value):
            raise RetrievalError(f"aggregation {name} must return a finite number")
        return pd.DataFrame({"query_id": frame["query_id"].iloc[:1], "page_id": frame["page_id"].iloc[:1], "score": [float(value)]})

    columns = fan_out(ranked).select("query_id", "page_id", "rank", "chunk_id", "score", "page_ids")
    return columns.groupBy("query_id", "page_id").applyInPandas(apply, "query_id long, page_id long, score double")


def rank_pages(pages: DataFrame, top_k: int = 100) -> DataFrame:
    """The first ``top_k`` pages of each query by descending score, then page id.

    Spark keeps ``top_k`` rows per query and task before the shuffle.
    """
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "page_id")
    return pages.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= check_top_k(top_k))


def with_contributors(ranked_pages: DataFrame, ranked_chunks: DataFrame) -> DataFrame:
    """Ranked pages with their contributors in rank order; only those of ranked pages are gathered."""
    wanted = fan_out(ranked_chunks).join(ranked_pages.select("query_id", "page_id"), ["query_id", "page_id"], "left_semi")
    gathered = wanted.groupBy("query_id", "page_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score", "page_ids"))).alias("chunks")
    )
    return ranked_pages.join(gathered, ["query_id", "page_id"])


def retrieve(
    index: DataFrame,
    queries: DataFrame,
    top_k: int = 100,
    aggregation: str | Callable = "max",
    index_type: str = "dense",
    decimals: int | None = None,
    contributors: bool = False,
    page_decimals: int | None = None,
) -> DataFrame:
    """``query_id, page_id, score, rank`` (and ``chunks``) for every query.

    ``decimals`` rounds the scores of chunks, ``page_decimals`` those of pages.
    """
    check_top_k(top_k)
    if not callable(aggregation) and aggregation not in AGGREGATIONS:
        raise RetrievalError(f"aggregation must be one of {AGGREGATIONS} or a function")
    if index_type == "dense" and not callable(aggregation):
        # rounding may make pages equal that are this far apart
        margin = 10.0**-page_decimals if page_decimals is not None else 0.0
        if aggregation == "max":
            scores = best_pages_dense(index, queries, top_k, decimals=decimals, margin=margin)
        else:
            scores = page_sums_dense(index, queries, top_k, aggregation, decimals=decimals, margin=margin)
        if page_decimals is not None:
            scores = scores.withColumn("score", F.round("score", page_decimals))
        pages = rank_pages(scores, top_k)
        if not contributors:
            return pages
        return contributors_dense(index, queries, checkpoint(pages), decimals=12 if decimals is None else decimals)
    if index_type == "dense":
        scored = rank_chunks(score_dense(index, queries, decimals=decimals))
    else:
        # candidates are cut before aggregation, so sums and means see no more than these
        scored = rank_chunks(score_late(index, queries, decimals=decimals, keep=CANDIDATES), CANDIDATES)
    pages = rank_pages(aggregate_pages(scored, aggregation, page_decimals), top_k)
    return with_contributors(pages, scored) if contributors else pages


def retrieval_payload(queries: DataFrame, retrieved: DataFrame) -> DataFrame:
    """``query_id, payload``: each query's pages as JSON in rank order; a query without pages has an empty list."""
    columns = [c for c in ("rank", "page_id", "score", "chunks") if c in retrieved.columns]
    pages = retrieved.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("pages"))
    joined = queries.select("query_id").distinct().join(pages, "query_id", "left")
    return joined.select("query_id", F.coalesce(F.to_json("pages"), F.lit("[]")).alias("payload"))
