"""Oversized items cut into pieces at natural boundaries.

For each item over its limit the least number of pieces is computed, equal
targets are placed, and each target is moved to the strongest boundary near it
from which the rest still fits; where no boundary lies in reach a piece is
added, as often as needed: the cut goes back to the last boundary of the piece,
and the targets of the rest are placed anew.  Only a piece without any boundary
inside is cut at a bare position.

Defined results: items within the limit and null or empty contents give no
pieces; lengths and offsets are code points; repeated rows count once; each
piece after the first starts exactly ``overlap`` characters before the end of
the one before; an item whose kind has no limit is not oversized; other columns
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIECES = "item_kind string, item_key string, piece_no int, n_pieces int, start int, end int, content string"

#: Boundaries by strength, strongest first; a cut lies at the start of the match's blank.
_BOUNDARIES = tuple(
    re.compile(p)
    for p in (
        r"\s*\n\s*\n\s*",
        r"[ \t]*\n[ \t]*",
        r"(?<=[.!?…])[\"'»”)\]]*(\s+)",
        r"(?<=[,;:])(\s+)",
        r"\s+",
    )
)


def _best_cut(text: str, low: int, high: int, target: int) -> tuple[int, int] | None:
    """(position, strength) of the strongest boundary in [low, high], nearest the target among equals."""
    for strength, pattern in zip(range(len(_BOUNDARIES), 0, -1), _BOUNDARIES):
        best = None
        for m in pattern.finditer(text, max(0, low - 1), min(len(text), high + 8)):
            at = m.start(1) if m.re.groups else m.start()
            if low <= at <= high and (best is None or abs(at - target) < abs(best - target)):
                best = at
        if best is not None:
            return best, strength
    return None


def cut_points(text: str, max_size: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open spans of the pieces of one text."""
    if max_size < 1 or overlap < 0 or overlap >= max_size:
        raise ValueError("need 0 <= overlap < max_size")
    n = len(text)
    if n <= max_size:
        return [(0, n)] if n else []
    step = max_size - overlap
    reach = max(40, step // 5)
    ends: list[int] = []
    at = overlap
    while n - at > step:
        left = -(-(n - at) // step)
        high, low = min(n - 1, at + step), max(at + 1, n - (left - 1) * step)
        target = min(max(at + (n - at) // left, low), high)
        # a good place near the target, else anything that still lets the rest fit, else a piece more
        cut = (
            _best_cut(text, max(low, target - reach), min(high, target + reach), target)
            or _best_cut(text, low, high, target)
            or (_best_cut(text, at + 1, low - 1, low) if low > at + 1 else None)
        )
        at = cut[0] if cut else target
        ends.append(at)
    starts = [0, *(e - overlap for e in ends)]
    return list(zip(starts, [*ends, n]))


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for kind, key, text, most, overlap in frame.itertuples(index=False):
            spans = cut_points(text, int(most), int(overlap))
            out += [(kind, key, k, len(spans), a, b, text[a:b]) for k, (a, b) in enumerate(spans)]
        yield pd.DataFrame(
            out, columns=["item_kind", "item_key", "piece_no", "n_pieces", "start", "end", "content"]
        )


def size_table(limits: DataFrame) -> DataFrame:
    """The strictest character limit of each purpose with its overlap: at most one row per purpose."""
    return (
        limits.where("unit = 'characters' and max_size is not null")
        .groupBy(F.col("purpose").alias("kind"))
        .agg(F.min(F.struct("max_size", F.coalesce("overlap", F.lit(0)).alias("overlap"))).alias("least"))
        .select("kind", "least.*")
    )


def split_items(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of the oversized rows of ``items(item_kind, item_key, content)``.

    Only rows over their limit leave the JVM.  ``limits`` has one row per
    purpose, so it is broadcast.
    """
    sizes = F.broadcast(size_table(limits))
    over = (
        items.select("item_kind", "item_key", "content")
        .join(sizes, F.col("item_kind") == F.col("kind"))
        .where(F.length("content") > F.col("max_size"))
        .select("item_kind", "item_key", "content", "max_size", "overlap")
        .distinct()
    )
    return over.mapInPandas(_cut, PIECES)


def rule_breaks(items: DataFrame, limits: DataFrame) -> DataFrame:
    """``item_kind, items, too_long, wrong_overlap, not_joined``: cut items per kind, and those that break a rule.

    An item is told by its key and text, so a key with two texts is two items.
    """
    sizes = F.broadcast(size_table(limits))
    texts = items.select("item_kind", "item_key", "content").distinct().withColumn("whole", F.xxhash64("content"))
    keyed = texts.select("item_kind", F.concat_ws(":", "item_key", F.col("whole").cast("string")).alias("item_key"), "content")
    pieces = split_items(keyed, limits).join(sizes.withColumnRenamed("kind", "item_kind"), "item_kind")
    in_order = F.array_sort(F.collect_list(F.struct("piece_no", "start", "end", "content")))
    joined = F.expr("aggregate(p, '', (s, x) -> concat(s, if(x.piece_no = 0, x.content, substring(x.content, overlap + 1))))")
    lapped = F.expr("forall(p, x -> x.piece_no = 0 or p[x.piece_no - 1].end - x.start = overlap)")
    cut = pieces.groupBy("item_kind", "item_key", "max_size", "overlap").agg(in_order.alias("p"), F.max(F.length("content")).alias("longest"))
    told = cut.select(
        "item_kind",
        (F.col("longest") > F.col("max_size")).alias("too_long"),
        (~lapped).alias("wrong_overlap"),
        (F.xxhash64(joined).cast("string") != F.substring_index("item_key", ":", -1)).alias("not_joined"),
    )
    counts = [F.count_if(c).alias(c) for c in ("too_long", "wrong_overlap", "not_joined")]
    return told.groupBy("item_kind").agg(F.count("*").alias("items"), *counts)


def page_spans(pages: DataFrame) -> DataFrame:
    """``doc_id, page_id, begin, finish`` of success pages in their document's text."""
    usable = (
        pages.where("status = 'success' and content is not null and content <> ''")
        .select("doc_id", "page_id", "page_number", F.length("content").alias("n"))
        .distinct()
    )
    before = Window.partitionBy("doc_id").orderBy("page_number", "page_id").rowsBetween(Window.unboundedPreceding, -1)
    return usable.withColumn("begin", F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0))).select(
        "doc_id", "page_id", "begin", (F.col("begin") + F.col("n")).alias("finish")
    )


def chunk_piece_pages(pieces: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_ids`` of the pieces of chunks: the chunk's pages that the piece overlaps.

    Chunks of one page hand it on; only the pieces of chunks over several pages
    meet the page spans, by document and page.
    """
    own = chunks.select(
        F.col("chunk_id").alias("item_key"), "doc_id", F.col("char_start").alias("origin"), F.col("page_ids").alias("of")
    ).distinct()
    placed = pieces.where("item_kind = 'chunk'").join(own, "item_key", "left")
    single = placed.where("of is null or size(of) <= 1").withColumn("page_ids", F.col("of"))
    names = ["item_key", "piece_no", "start", "end"]
    wide = placed.where("size(of) > 1").withColumn("page_id", F.explode("of"))
    met = (
        wide.join(page_spans(pages), ["doc_id", "page_id"])
        .where("origin + start < finish and origin + end > begin")
        .groupBy(*names, "doc_id", "origin")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("begin", "page_id"))), lambda x: x["page_id"]).alias("page_ids"))
    )
    return single.select(*names, "page_ids").unionByName(met.select(*names, "page_ids"))
