"""Lines repeated across the documents of one source, found and removed.

Every line is reduced to a key (its words, digit runs as ``0``) and stored with
the documents that hold it as a compressed bitmap: rows of (source, key, word
number, 64 bits), empty words left out.  Variants of a line share a key, so a
bitwise OR unites their bitmaps; the exact cardinality is the sum of bit counts.
An occurrence is deleted when its document's bit is set in the bitmap of a line
over the thresholds.

Most lines occur once.  Occurrences are counted by key first; a key with fewer
than the least number of documents cannot reach it, and only occurrences of the
other keys are given bitmaps or shuffled again.

Keys are two independent 64-bit hashes of source and reduced line; a false
match needs both to collide.

Defined results: null contents have no lines; documents unknown to the
metadata, or of a null source, belong to no source and keep their lines; a
document listed under two sources counts for both; repeated rows count once;
lines under ``least_letters`` letters never count; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import checkpoint, materialize, spread


def _reduced(content: Column) -> Column:
    """The page's lines, reduced to words with digit runs as 0; one pass over the whole text each."""
    words = F.regexp_replace(F.lower(content), r"[^\p{L}\p{N}\n]+", " ")
    return F.split(F.regexp_replace(words, r"\p{N}+", "0"), "\n")


def _letters(line: Column) -> Column:
    return F.length(F.translate(line, " 0", ""))


def document_numbers(metadata: DataFrame) -> DataFrame:
    """``doc_id, source, ordinal``: dense 64-bit numbers in source order, fixed by a checkpoint."""
    docs = (
        metadata.select(F.col("doc_id"), F.col("publisher").alias("source"))
        .where("doc_id is not null and source is not null")
        .distinct()
    )
    return checkpoint(docs.orderBy("source", "doc_id").withColumn("ordinal", F.monotonically_increasing_id()))


def source_sizes(documents: DataFrame) -> DataFrame:
    """``source, source_no, of_source``: a source's number is its first document's."""
    return documents.groupBy("source").agg(F.min("ordinal").alias("source_no"), F.count("*").alias("of_source"))


def line_occurrences(pages: DataFrame, documents: DataFrame, sizes: DataFrame, least_letters: int) -> DataFrame:
    """``k1, k2, source_no, slot, bit, page_id, line_no`` of every countable line.

    Lines are hashed before the shuffle by document, which carries an array of
    hashes per page instead of a row per line.
    """
    numbered = F.transform(_reduced(F.col("content")), lambda x, i: F.struct(i.alias("no"), F.trim(x).alias("line")))
    counted = F.filter(numbered, lambda r: _letters(r["line"]) >= least_letters)
    hashed = F.transform(
        counted, lambda r: F.struct(r["no"], F.xxhash64(r["line"]).alias("h1"), F.xxhash64(F.lit(7), r["line"]).alias("h2"))
    )
    lines = spread(pages.where("content is not null").select("page_id", "doc_id", "content")).select("page_id", "doc_id", hashed.alias("lines"))
    owners = documents.join(sizes.select("source", "source_no"), "source").select("doc_id", "source_no", "ordinal")
    return (
        lines.join(owners, "doc_id")
        # outer, as the optimizer would test an inner one's array before the join: it would be made three times
        .select("page_id", "source_no", "ordinal", F.explode_outer("lines").alias("r"))
        .where("r is not null")
        .select(
            F.xxhash64("source_no", "r.h1").alias("k1"),
            F.xxhash64("source_no", "r.h2").alias("k2"),
            "source_no",
            F.shiftright("ordinal", 6).alias("slot"),
            F.expr("shiftleft(1L, cast(ordinal % 64 as int))").alias("bit"),
            "page_id",
            F.col("r.no").alias("line_no"),
        )
    )


def line_bitmaps(occurrences: DataFrame) -> DataFrame:
    """``k1, k2, slot, bits, source_no``: map-side OR, so a hot line is one row per task and slot."""
    return occurrences.groupBy("k1", "k2", "slot").agg(F.bit_or("bit").alias("bits"), F.max("source_no").alias("source_no"))


def repeated_lines(bitmaps: DataFrame, sizes: DataFrame, least_docs: int, least_share: float) -> DataFrame:
    """``k1, k2, source, n_docs, of_source`` of the lines over both thresholds."""
    counts = bitmaps.groupBy("k1", "k2").agg(F.sum(F.bit_count("bits")).alias("n_docs"), F.max("source_no").alias("source_no"))
    return (
        counts.where(F.col("n_docs") >= least_docs)
        .join(sizes, "source_no")
        .where(F.col("n_docs") >= F.col("of_source") * least_share)
        .select("k1", "k2", "source", "n_docs", "of_source")
    )


def _may_repeat(occurrences: DataFrame, least_docs: int, bits: int = 23) -> DataFrame:
    """Occurrences whose key occurs at least ``least_docs`` times, and the few that share a bit with such a key.

    The counts are exact; the keys that reach the number set bits of a fixed
    table (2**(bits-6) rows at most, whatever the input), which is broadcast, so
    lines that cannot repeat never reach the shuffle by key.
    """
    often = occurrences.groupBy("k1").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs)
    slot = F.pmod("k1", F.lit(1 << bits))
    word, flag = F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(k1, {1 << bits}) % 64 as int))")
    table = often.groupBy(word).agg(F.bit_or(flag).alias("flags"))
    marked = occurrences.withColumn("word", word).join(F.broadcast(table), "word")
    return marked.where(F.col("flags").bitwiseAND(flag) != 0).drop("word", "flags")


def find_repeated_lines(
    pages: DataFrame,
    metadata: DataFrame,
    least_docs: int = 4,
    least_share: float = 0.2,
    least_letters: int = 20,
) -> DataFrame:
    """``page_id, line_no, source, n_docs, of_source`` of every occurrence of a repeated line."""
    documents = document_numbers(metadata)
    sizes = source_sizes(documents)
    # read for the counts, the bitmaps and the deletion
    found = _may_repeat(materialize(line_occurrences(pages, documents, sizes, least_letters)), least_docs)
    bitmaps = line_bitmaps(found)
    repeated = repeated_lines(bitmaps, sizes, least_docs, least_share)
    held = bitmaps.select("k1", "k2", "slot", "bits").join(repeated, ["k1", "k2"])
    hit = found.drop("source_no").join(held, ["k1", "k2", "slot"])
    return (
        hit.where((F.col("bits").bitwiseAND(F.col("bit"))) != 0)
        .select("page_id", "line_no", "source", "n_docs", "of_source")
        .distinct()
    )


def remove_lines(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``page_id, content, removed`` of the pages that lose lines, each distinct content once."""
    gone = found.groupBy("page_id").agg(F.collect_set("line_no").alias("gone"))
    kept = pages.where("content is not null").select("page_id", "content").distinct().join(gone, "page_id")
    lines = F.split("content", "\n")
    clean = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(F.col("gone"), i)), "\n")
    return kept.select("page_id", clean.alias("content"), F.size("gone").alias("removed"))


def repeated_texts(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``source, line, n_docs, of_source, occurrences``: the repeated lines in reduced form."""
    reduced = F.element_at(_reduced(F.col("content")), F.col("line_no") + 1)
    texts = pages.where("content is not null").select("page_id", "content").distinct()
    lines = found.join(texts, "page_id").select("source", "n_docs", "of_source", F.trim(reduced).alias("line"))
    return lines.groupBy("source", "line", "n_docs", "of_source").agg(F.count("*").alias("occurrences"))
