"""JSON-lines and tab-separated records, read with explicit schemas and checked."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.errors import CollectionError
from folioscope.sources import files


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, extra: str | None = None) -> DataFrame:
    """Records of a JSON-lines file; blank lines are skipped.

    Fields outside the schema are an error, or are kept as JSON text by key in
    the map column ``extra``.  A line that is no object, lacks a required field
    or has one of another type is an error that shows it.
    """
    fields = [f for f in schema.fields if f.name != extra]
    lines = spark.read.text(path).where(F.col("value").rlike(r"(?U)\S"))
    typed = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    keys = F.json_object_keys("value")
    parsed = lines.select(
        "value",
        F.from_json("value", typed, {"mode": "PERMISSIVE", "allowNumericLeadingZeros": "false"}).alias("record"),
        keys.alias("keys"),
        F.from_json("value", "map<string,string>").alias("all"),
    )
    names = F.array(*[F.lit(f.name) for f in fields])
    required = [f.name for f in fields if not f.nullable]
    bad = F.col("keys").isNull()
    for name in required:
        bad = bad | F.col(f"record.{name}").isNull()
    if extra is None:
        bad = bad | (F.size(F.array_except("keys", names)) > 0)
    broken = parsed.where(F.coalesce(bad, F.lit(True))).select("value").take(3)
    if broken:
        raise CollectionError(f"{path}: " + "; ".join(r["value"][:200] for r in broken))
    columns = [F.col(f"record.{f.name}").alias(f.name) for f in fields]
    if extra is not None:
        columns.append(F.map_filter("all", lambda k, _: ~F.array_contains(names, k)).alias(extra))
    return parsed.select(*columns)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, page_id, score`` of a tab-separated file with header; other columns are ignored."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    lacking = {"query_id", "page_id", "score"} - set(rows.columns)
    if lacking:
        raise CollectionError(f"{path} lacks the columns {sorted(lacking)}")
    out = rows.select(
        F.expr("try_cast(query_id as bigint)").alias("query_id"),
        F.expr("try_cast(page_id as bigint)").alias("page_id"),
        F.expr("try_cast(score as int)").alias("score"),
    )
    broken = out.where("query_id is null or page_id is null or score is null").take(1)
    if broken:
        raise CollectionError(f"{path} holds a value that is no integer: {broken[0].asDict()}")
    return out


def write_jsonl(rows: DataFrame, path: str) -> None:
    """A folder of JSON-lines parts, written beside its place and moved there whole; a map column ``extra`` is laid open."""
    part = f"{str(path).rstrip('/')}.part-{uuid.uuid4().hex}"
    if "extra" in rows.columns:
        names = [c for c in rows.columns if c != "extra"]
        own = F.to_json(F.struct(*names))
        more = F.to_json("extra")
        joined = F.when(F.size("extra") > 0, F.concat(F.substring(own, F.lit(1), F.length(own) - 1), F.lit(","), F.substring(more, F.lit(2), F.length(more)))).otherwise(own)
        rows.select(joined.alias("value")).write.text(part)
    else:
        rows.write.json(part)
    files.move(part, path)


def write_text_atomic(path: str, text: str) -> None:
    """A small file from the driver, complete or not there at all."""
    files.write_text(path, text)


def write_json_atomic(path: str, value: Any) -> None:
    write_text_atomic(path, json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n")


def copy_into(source: str, target: str) -> None:
    """Copy a file into place; copying a file onto itself does nothing."""
    if not files.is_file(source):
        raise CollectionError(f"{source} does not exist")
    files.copy(source, target)
