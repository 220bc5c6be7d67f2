"""Queries of the operators for training data over the supplied tables."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import language, leakage, neardup, packing, scans, site_lines, split, topn, truncation
from folioscope.session import checkpoint, read_table


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_n(read_table(spark, sf_dir, "retrieved_pages"), 10)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("query_id", "page_id")


def p5_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "parsed_pages").where("status = 'success'")
    chunks = read_table(spark, sf_dir, "chunks")
    return pages.select(
        F.lit("page").alias("item_kind"), F.col("page_id").cast("string").alias("item_key"), "content"
    ).unionByName(chunks.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_key"), "content"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_items(_items(spark, sf_dir), read_table(spark, sf_dir, "size_limits"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).where("n_pieces > 1").select("item_kind", "item_key").distinct()


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


def p6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items cut per kind, and those whose pieces are too long, overlap wrongly or do not join to the item's text."""
    return split.rule_breaks(_items(spark, sf_dir), read_table(spark, sf_dir, "size_limits"))


def p6_chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, pages = read_table(spark, sf_dir, "chunks"), read_table(spark, sf_dir, "parsed_pages")
    return split.chunk_piece_pages(_pieces(spark, sf_dir), chunks, pages)


def _repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.find_repeated_lines(
        read_table(spark, sf_dir, "parsed_pages"), read_table(spark, sf_dir, "documents_metadata")
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeated(spark, sf_dir).select("page_id", "line_no").distinct()


def p7_clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.remove_lines(read_table(spark, sf_dir, "parsed_pages"), _repeated(spark, sf_dir))


def p7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = site_lines.repeated_texts(read_table(spark, sf_dir, "parsed_pages"), _repeated(spark, sf_dir))
    return texts.select(F.col("source").alias("publisher"), "line", "n_docs", "of_source")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.remove_leaks(read_table(spark, sf_dir, "documents"), _leaks(spark, sf_dir))


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that leaked, with the documents that hold them and their longest run of words."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(
        F.countDistinct("doc_id").alias("documents"), F.max("n_words").alias("longest_words")
    )


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.detect_truncation(read_table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where("truncated").select("doc_id").distinct()


def p10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_report(_judged(spark, sf_dir))


def p10_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    endings = truncation.text_endings(read_table(spark, sf_dir, "documents"))
    return truncation.length_limits(endings).select("source", "unit", "size", "n")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [read_table(spark, sf_dir, t) for t in ("parsed_pages", "documents_metadata", "queries")]
    model = language.fit_model(language.labelled_sample(*tables), language.vocabulary_pieces())
    return language.record_languages(*tables, model)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.unlabelled_languages(_records(spark, sf_dir))


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of every report's pages and the clauses of every query, with language and confidence."""
    tables = [read_table(spark, sf_dir, t) for t in ("parsed_pages", "documents_metadata", "queries")]
    model = language.fit_model(language.labelled_sample(*tables), language.vocabulary_pieces())
    return language.page_segments(tables[0], model).unionByName(language.query_segments(tables[2], model))


def p2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir)


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return neardup.near_copies(read_table(spark, sf_dir, "chunks"), k=3, threshold=Fraction(3, 5))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.chunk_pairs(*_links(spark, sf_dir))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_classes(*_links(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [read_table(spark, sf_dir, t) for t in ("parsed_pages", "documents_metadata")]
    return scans.scan_noise(scans.study_scans(*tables))


def p3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [read_table(spark, sf_dir, t) for t in ("parsed_pages", "documents_metadata")]
    return scans.repair_scans(tables[0], scans.study_scans(*tables), tables[1])


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "size_limits"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, sf_dir))


def p8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each capacity, texts and tokens they cover, and containers that break a rule."""
    packed = checkpoint(p8_containers(spark, sf_dir))
    broken = packing.rule_breaks(packed).groupBy("capacity").agg(F.count("*").alias("broken"))
    return (
        packed.groupBy("capacity")
        .agg(F.countDistinct("doc_id").alias("texts"), F.max("n_tokens").alias("largest"))
        .join(broken, "capacity", "left")
        .select("capacity", "texts", (F.col("largest") <= F.col("capacity")).alias("within"), F.coalesce("broken", F.lit(0)).alias("broken"))
    )


QUERIES = {
    f.__name__: f
    for f in (p5_found, p5_ranked, p6_found, p6_pieces, p6_rules, p6_chunk_pages, p7_found, p7_lines, p7_clean_pages, p9_found, p9_items, p9_clean, p10_found, p10_sources, p10_limits, p2_found, p2_languages, p2_segments, p1_found, p1_classes, p3_found, p3_pages, p8_containers, p8_fill, p8_rules)
}
