"""Collections: documents, pages, queries and judgments, made or loaded, and checked."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope import schemas
from folioscope.errors import CollectionError
from folioscope.operators.checks import collection_conflicts, duplicates, require
from folioscope.session import checkpoint
from folioscope.sources import files
from folioscope.sources.records import copy_into, read_jsonl, read_qrels, write_jsonl

FILES = {
    "corpus": "corpus.jsonl",
    "documents": "documents_metadata.jsonl",
    "queries": "queries.jsonl",
    "qrels": "qrels.tsv",
}


@dataclass(frozen=True)
class Collection:
    """Lazy tables of one collection; ``queries`` and ``qrels`` come together or not at all."""

    root: str
    pages: DataFrame
    documents: DataFrame
    queries: DataFrame | None = None
    qrels: DataFrame | None = None


def scan_documents(spark: SparkSession, root: str, suffix: str = "pdf") -> DataFrame:
    """``file_name, doc_id, local_path, data`` of the documents in a folder, not below it.

    The suffix matches in any case; two files of one stem are an error.
    """
    pattern = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    out = files.select(
        name.alias("file_name"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"),
        F.regexp_replace("path", r"^file:/+", "/").alias("local_path"),
        F.col("content").alias("data"),
    )
    require({"two files of one name": duplicates(out.select("doc_id"), "doc_id")}, CollectionError)
    return out


def count_pages(scanned: DataFrame, counter: Callable[[bytes], int]) -> DataFrame:
    """``doc_id, page_number``: pages per document, counted in the workers."""

    @F.pandas_udf("int")
    def count(data: pd.Series) -> pd.Series:
        return data.map(lambda b: counter(bytes(b)))

    return scanned.select("file_name", "doc_id", "local_path", count("data").alias("page_number"))


def form_feed_pages(data: bytes) -> int:
    """Pages of a text in which a form feed ends a page."""
    return data.count(b"\f") + 1


def pdf_pages(data: bytes) -> int:
    """Pages of a PDF by its page objects; enough where no PDF library is installed."""
    try:
        import pymupdf
    except ImportError:
        return len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", data))
    with pymupdf.open(stream=data, filetype="pdf") as document:
        return document.page_count


def create_corpus(documents: DataFrame) -> DataFrame:
    """``page_id, doc_id, page_number``: pages numbered through in file-name order.

    Offsets are sums over ranges of documents, so no task holds all documents.
    """
    ranged = documents.select("file_name", "doc_id", "page_number").repartitionByRange(F.lower("file_name"), "file_name")
    # fixed, so that sizes and places are of the same ranges
    placed = checkpoint(ranged.withColumn("part", F.spark_partition_id()))
    sizes = placed.groupBy("part").agg(F.sum("page_number").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "base")
    inner = Window.partitionBy("part").orderBy(F.lower("file_name"), "file_name").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.withColumn("within", F.coalesce(F.sum("page_number").over(inner), F.lit(0))).join(offsets, "part")
    return first.where("page_number > 0").select(
        "doc_id", (F.col("base") + F.col("within")).alias("first"), F.explode(F.sequence(F.lit(0), F.col("page_number") - 1)).alias("page_number")
    ).select((F.col("first") + F.col("page_number")).cast("long").alias("page_id"), "doc_id", F.col("page_number").cast("int").alias("page_number"))


def default_metadata(counted: DataFrame) -> DataFrame:
    """Document records that hold what the file itself tells."""
    return counted.select("file_name", "doc_id", "local_path", F.col("page_number").cast("int").alias("page_number"), F.expr("cast(map() as map<string,string>)").alias("extra"))


def validate_collection(collection: Collection, counted: DataFrame | None = None) -> None:
    """All rules; with the folder's documents and their pages (``counted``) also those between records and files."""
    if (collection.queries is None) != (collection.qrels is None):
        raise CollectionError("queries and qrels must come together")
    conflicts = collection_conflicts(collection.pages, collection.documents, collection.queries, collection.qrels)
    require(conflicts, CollectionError)
    if counted is not None:
        require({"documents": document_conflicts(collection.documents, counted)}, CollectionError)


def load_collection(
    spark: SparkSession,
    root: str,
    validate: bool = True,
    suffix: str | None = None,
    counter: Callable[[bytes], int] = pdf_pages,
) -> Collection:
    """The collection kept in a folder, read with its schemas and checked.

    With a ``suffix`` the folder's documents are read too, and records must
    name each of them, by its stem, with its number of pages.
    """
    at = {k: f"{root}/{v}" for k, v in FILES.items()}
    pages = read_jsonl(spark, at["corpus"], schemas.PAGE)
    documents = read_jsonl(spark, at["documents"], schemas.DOCUMENT, extra="extra")
    queries = read_jsonl(spark, at["queries"], schemas.QUERY, extra="extra") if files.exists(at["queries"]) else None
    qrels = read_qrels(spark, at["qrels"]) if files.exists(at["qrels"]) else None
    out = Collection(root, pages, documents, queries, qrels)
    if validate:
        validate_collection(out, count_pages(scan_documents(spark, root, suffix), counter) if suffix else None)
    return out


def initialize_collection(
    spark: SparkSession,
    root: str,
    corpus: str | None = None,
    documents: str | None = None,
    queries: str | None = None,
    qrels: str | None = None,
    suffix: str = "pdf",
    counter: Callable[[bytes], int] = pdf_pages,
) -> Collection:
    """Take over the files given, make the corpus and document records that are not, and load."""
    if not files.is_folder(root):
        raise CollectionError(f"{root} is no folder")
    if (queries is None) != (qrels is None):
        raise CollectionError("queries and qrels must come together")
    given = {"corpus": corpus, "documents": documents, "queries": queries, "qrels": qrels}
    for name, source in given.items():
        if source is not None:
            copy_into(source, f"{root}/{FILES[name]}")
    lacking = [n for n in ("corpus", "documents") if not files.exists(f"{root}/{FILES[n]}")]
    if lacking:
        scanned = scan_documents(spark, root, suffix)
        if not scanned.take(1):
            raise CollectionError(f"{root} holds no .{suffix} documents")
        counted = count_pages(scanned, counter)
        if "corpus" in lacking:
            write_jsonl(create_corpus(counted), f"{root}/{FILES['corpus']}")
        if "documents" in lacking:
            write_jsonl(default_metadata(counted), f"{root}/{FILES['documents']}")
    return load_collection(spark, root)


def document_conflicts(documents: DataFrame, scanned: DataFrame) -> DataFrame:
    """Records and files that lack each other or disagree in name, stem or number of pages: ``doc_id, rule``."""
    pages = F.col("page_number") if "page_number" in scanned.columns else F.lit(None).cast("int")
    files = scanned.select("doc_id", F.col("file_name").alias("file"), pages.alias("held"))
    both = documents.select("doc_id", "file_name", F.col("page_number").alias("declared")).join(files, "doc_id", "full_outer")
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    rule = (
        F.when(F.col("file").isNull(), "no file")
        .when(F.col("file_name").isNull(), "no record")
        .when(F.col("file") != F.col("file_name"), "other file name")
        .when(stem != F.col("doc_id"), "id is not the stem")
        .when(F.col("held") != F.coalesce("declared", F.lit(-1)), "other number of pages")
    )
    return both.withColumn("rule", rule).where("rule is not null").select("doc_id", "rule")
