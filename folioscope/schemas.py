"""Explicit schemas of the records the engine exchanges; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

PAGE = T.StructType(
    [
        T.StructField("page_id", T.LongType(), False),
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("page_number", T.IntegerType(), False),
    ]
)
DOCUMENT = T.StructType(
    [
        T.StructField("file_name", T.StringType(), False),
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("local_path", T.StringType(), False),
        T.StructField("page_number", T.IntegerType(), False),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)
QUERY = T.StructType(
    [
        T.StructField("query_id", T.LongType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)
QREL = T.StructType(
    [
        T.StructField("query_id", T.LongType(), False),
        T.StructField("page_id", T.LongType(), False),
        T.StructField("score", T.IntegerType(), False),
    ]
)
PARSED_PAGE = T.StructType(
    [
        T.StructField("page_id", T.LongType(), False),
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("page_number", T.IntegerType(), False),
        T.StructField("content", T.StringType()),
        T.StructField("content_format", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
CHUNK = T.StructType(
    [
        T.StructField("chunk_id", T.StringType(), False),
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("page_ids", T.ArrayType(T.LongType()), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("start", T.IntegerType(), False),
        T.StructField("end", T.IntegerType(), False),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
CONTRIBUTOR = "struct<rank:int,chunk_id:string,score:double,page_ids:array<bigint>>"
RETRIEVED_PAGE = f"query_id long, page_id long, score double, rank int, chunks array<{CONTRIBUTOR}>"
