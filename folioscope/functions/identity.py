"""Content addresses: every stage is named by a hash of its configuration and of the stage before."""

from __future__ import annotations

import dataclasses
import enum
import hashlib
import json
import uuid
import warnings
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical(value: Any) -> str:
    """Sorted, compact JSON."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def digest(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def chunking_payload(name: str, options: Mapping[str, Any], cache_key: str | None, nonce: str | None = None) -> dict:
    """The JSON form of chunking options.

    Functions and other objects are told by their type and the cache key;
    without one they are tied to this run, and a warning says so.
    """
    mark = {"cache_key": cache_key} if cache_key else {"run": nonce or uuid.uuid4().hex}
    unnamed: list[str] = []

    def plain(value: Any) -> Any:
        if isinstance(value, enum.Enum):
            return value.value
        if dataclasses.is_dataclass(value) and not isinstance(value, type):
            return {"type": _kind(type(value)), "fields": {f.name: getattr(value, f.name) for f in dataclasses.fields(value)}}
        for form, make in ((Mapping, dict), (range, list), (set, sorted), (frozenset, sorted)):
            if isinstance(value, form):
                return make(value)
        unnamed.append(_kind(value if hasattr(value, "__qualname__") else type(value)))
        return {"type": unnamed[-1], **mark}

    normal = json.loads(json.dumps(dict(options), default=plain))
    if unnamed and not cache_key:
        warnings.warn(f"{', '.join(unnamed)} in options without a cache key: other runs do not reuse this result", RuntimeWarning, stacklevel=3)
    return {"chunker_name": name, "options": normal, "cache_key": cache_key}


def _kind(value: Any) -> str:
    return f"{getattr(value, '__module__', '')}.{value.__qualname__}"


def aggregation_name(aggregation: str | Callable) -> str:
    if isinstance(aggregation, str):
        return aggregation
    return "custom:" + _kind(aggregation if hasattr(aggregation, "__qualname__") else type(aggregation))


def rows_identity(rows: DataFrame, *columns: str) -> DataFrame:
    """``identity``: SHA-256 over all distinct rows whatever their order.

    Rows are hashed where they are; hashes of one beginning are sorted and
    hashed together (4,096 groups, so none holds more than its share), and the
    groups' hashes, in order, make the identity.  A value is written with its
    length, so no two rows are written alike.
    """
    values = [F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    hashed = rows.select(F.sha2(F.concat(*values), 256).alias("h")).distinct()
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    groups = hashed.groupBy(F.substring("h", 1, 3).alias("g")).agg(joined("h").alias("h"))
    return groups.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), ""), 256).alias("identity"))


def query_set_identity(queries: DataFrame) -> DataFrame:
    """Identity of the (id, text) pairs; other columns do not count."""
    return rows_identity(queries, "query_id", "text")


def qrels_identity(qrels: DataFrame) -> DataFrame:
    return rows_identity(qrels, "query_id", "page_id", "score")
