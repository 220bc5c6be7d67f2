"""Chunkers, encoders and vector functions under SQL names."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from folioscope.operators.chunking import SpanFunction, get_chunker, normalize_spans


def chunk_function(function: SpanFunction):
    """A table function ``(text, options as JSON) -> place, start, end, content`` from a chunker."""

    class Chunks:
        def eval(self, text: str, options: str) -> Iterator[tuple]:
            if text:
                chosen = json.loads(options) if options else {}
                for place, s in enumerate(normalize_spans(text, function(text, **chosen))):
                    yield place, int(s.start), int(s.end), s.content

    return udtf(Chunks, returnType="place int, start int, end int, content string")


#: Column expressions by SQL name.
_MACROS = {
    "vector_dot(a array<double>, b array<double>)": ("double", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "vector_length(a array<double>)": ("double", "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"),
    "page_state(content string)": (
        "string",
        r"case when content is null then 'failed' when not content rlike '(?U)\\S' then 'empty' else 'success' end",
    ),
}


def register_sql(spark: SparkSession, *chunkers: str) -> list[str]:
    """Register ``chunk_<name>`` table functions and the scalar functions; returns all names.

    The chunker itself travels with the function, so workers need no registry.
    """
    names = []
    for name in chunkers or ("token", "sentence", "recursive", "fast"):
        spark.udtf.register(f"chunk_{name}", chunk_function(get_chunker(name)))
        names.append(f"chunk_{name}")
    for head, (kind, body) in _MACROS.items():
        spark.sql(f"create or replace temporary function {head} returns {kind} return {body}")
        names.append(head.split("(")[0])
    return names
