"""Indexes as tables: one row per chunk with its vector or token matrix.

A flat index needs no structure beyond the table; Parquet is its format.  The
position of a chunk is its place in chunk-id order.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.errors import IndexingError
from folioscope.functions.ranges import range_numbers
from folioscope.functions.vectors import l2_norm, l2_normalize
from folioscope.operators.checks import chunk_conflicts, duplicates, matrix_conflicts, not_contiguous, require, vector_conflicts
from folioscope.operators.encoders import Encoder, check_encoder, encode_column

INDEX_TYPES = ("dense", "late_interaction")
_OPTIONS = {"dense": {"batch_size", "device", "trust_remote_code"}, "late_interaction": {"batch_size", "device", "trust_remote_code", "show_progress"}}


@dataclass(frozen=True)
class IndexingConfig:
    """``model_name`` names the encoder; options are those of the encoder call."""

    model_name: str
    index_type: str = "dense"
    options: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.index_type not in INDEX_TYPES:
            raise IndexingError(f"index_type must be one of {INDEX_TYPES}")
        if not isinstance(self.model_name, str) or not self.model_name.strip():
            raise IndexingError("model_name must not be blank")
        unknown = set(self.options) - _OPTIONS[self.index_type]
        if unknown:
            raise IndexingError(f"unknown options {sorted(unknown)}")
        batch = self.options.get("batch_size", 32)
        if isinstance(batch, bool) or not isinstance(batch, int) or batch < 1:
            raise IndexingError("batch_size must be a positive integer")
        device = self.options.get("device")
        if device is not None and (not isinstance(device, str) or not device.strip()):
            raise IndexingError("device must not be blank")
        if not isinstance(self.options.get("trust_remote_code", False), bool):
            raise IndexingError("trust_remote_code must be true or false")


def index_positions(chunks: DataFrame) -> DataFrame:
    """``index_position, chunk_id``: 0-based places in chunk-id order."""
    return range_numbers(chunks.select("chunk_id"), [F.col("chunk_id").asc()], "index_position").select("index_position", "chunk_id")


def recorded_model(chunks: DataFrame) -> Column:
    """The model that made a chunk's embedding, as its metadata tell."""
    return F.col("metadata")["embedding_model"] if "metadata" in chunks.columns else F.lit(None).cast("string")


def precomputed_state(chunks: DataFrame, embedding: str = "embedding", model: Column | None = None) -> DataFrame:
    """``chunks, embedded, models, model, widths, width``: whether late-chunk embeddings can be used as they are."""
    name = model if model is not None else recorded_model(chunks)
    held = F.when(F.col(embedding).isNotNull(), F.size(embedding))
    return chunks.agg(
        F.count("*").alias("chunks"),
        F.count(embedding).alias("embedded"),
        F.countDistinct(name).alias("models"),
        F.min(name).alias("model"),
        F.countDistinct(held).alias("widths"),
        F.max(held).alias("width"),
    )


def index_conflicts(positions: DataFrame, chunks: DataFrame) -> DataFrame:
    """``rule, detail``: positions that are not 0 .. n-1, ids that come twice, and ids that only one side has."""
    ids = positions.select("chunk_id", F.lit(1).alias("indexed")).distinct()
    now = chunks.select("chunk_id", F.lit(1).alias("known")).distinct()
    apart = ids.join(now, "chunk_id", "full_outer").where("indexed is null or known is null")
    rule = lambda rows, name, detail: rows.select(F.lit(name).alias("rule"), F.col(detail).cast("string").alias("detail"))
    return (
        rule(not_contiguous(positions, "index_position"), "positions", "n")
        .unionByName(rule(duplicates(positions, "chunk_id"), "id twice", "chunk_id"))
        .unionByName(rule(apart, "not in both", "chunk_id"))
    )


def build_dense(
    chunks: DataFrame, encoder: Encoder | None, batch_size: int = 32, check: bool = True, model_name: str | None = None
) -> DataFrame:
    """``chunk_id, page_ids, embedding`` at unit length.

    With ``encoder`` None the chunks' own embeddings are used: all of them must
    be there, of one width and, where ``metadata`` names it, of one model, which
    is ``model_name`` if that is given.
    """
    if check:
        require({"chunk": chunk_conflicts(chunks), "chunk id twice": duplicates(chunks, "chunk_id")}, IndexingError)
    if encoder is None:
        state = precomputed_state(chunks, model=recorded_model(chunks)).first()
        if state["chunks"] != state["embedded"] or state["widths"] != 1:
            raise IndexingError("every chunk needs an embedding of the same width")
        if state["models"] > 1 or (model_name and state["model"] not in (None, model_name)):
            raise IndexingError(f"the embeddings are of {state['models']} models ({state['model']}), not of {model_name or 'one'}")
        raw, width = chunks, state["width"]
    else:
        check_encoder(encoder, "dense")
        raw, width = encode_column(chunks, "content", "embedding", encoder, batch_size), encoder.dimension
    if check:
        require({"vector": vector_conflicts(raw, width)}, IndexingError)
    else:
        # a zero vector has no direction, whoever checked the rest
        require({"zero vector": raw.where(~(l2_norm(F.col("embedding")) > 0))}, IndexingError)
    unit = F.transform(l2_normalize(F.col("embedding")), lambda x: x.cast("float"))
    return raw.select("chunk_id", "page_ids", unit.alias("embedding"))


def build_late(chunks: DataFrame, encoder: Encoder, batch_size: int = 32, check: bool = True) -> DataFrame:
    """``chunk_id, page_ids, tokens``: one token matrix per chunk."""
    check_encoder(encoder, "late_interaction")
    if check:
        require({"chunk": chunk_conflicts(chunks), "chunk id twice": duplicates(chunks, "chunk_id")}, IndexingError)
    out = encode_column(chunks, "content", "tokens", encoder, batch_size).select("chunk_id", "page_ids", "tokens")
    if check:
        require({"token matrix": matrix_conflicts(out, encoder.dimension)}, IndexingError)
    return out
