"""Encoders turn text into vectors inside the workers.

An encoder is a small picklable object; whatever is heavy (a model) it loads in
``encode`` on first use, so nothing but its configuration travels.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.errors import IndexingError

_WORD = re.compile(r"[^\W_]+")


class Encoder(Protocol):
    """``kind`` is dense (one vector a text) or late_interaction (a matrix a text)."""

    kind: str
    dimension: int

    def encode(self, texts: list[str]) -> list[Any]: ...


@functools.lru_cache(maxsize=200_000)
def _slot(word: str, dimension: int) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dimension


@dataclass(frozen=True)
class HashEncoder:
    """Counts of words in slots chosen by the first 32 bits of their MD5: no model, the same everywhere."""

    dimension: int = 256
    kind: str = field(default="dense", init=False)

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts):
            for word in _WORD.findall(text.lower()):
                row[_slot(word, self.dimension)] += 1
        return out.tolist()


@dataclass(frozen=True)
class HashTokenEncoder:
    """One unit vector per word, its direction drawn from the word's MD5; every word, unless ``most_tokens`` is set."""

    dimension: int = 16
    most_tokens: int | None = None
    kind: str = field(default="late_interaction", init=False)

    def encode(self, texts: list[str]) -> list[list[list[float]]]:
        out = []
        for text in texts:
            rows = []
            for word in _WORD.findall(text.lower())[: self.most_tokens]:
                seed = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
                v = np.random.default_rng(seed).standard_normal(self.dimension)
                rows.append((v / np.linalg.norm(v)).tolist())
            out.append(rows)
        return out


@dataclass(frozen=True)
class ModelEncoder:
    """A Sentence Transformers model by name; loaded once per worker.

    Of kind late_interaction it gives the vectors of a text's tokens.
    """

    model_name: str
    dimension: int
    kind: str = "dense"
    device: str | None = None
    trust_remote_code: bool = False

    def encode(self, texts: list[str]) -> list[Any]:
        return self._run(_model(self.model_name, self.device, self.trust_remote_code), ("encode",), texts)

    def encode_query(self, texts: list[str]) -> list[Any]:
        """As the model encodes questions, where it has a way of its own for them."""
        return self._run(_model(self.model_name, self.device, self.trust_remote_code), ("encode_query", "encode"), texts)

    def _run(self, model: Any, names: tuple[str, ...], texts: list[str]) -> list[Any]:
        call = next(getattr(model, n) for n in names if hasattr(model, n))
        if self.kind == "dense":
            return np.asarray(call(texts)).tolist()
        return [np.asarray(m.cpu() if hasattr(m, "cpu") else m).tolist() for m in call(texts, output_value="token_embeddings")]


@functools.lru_cache(maxsize=2)
def _model(name: str, device: str | None, trust: bool) -> Any:
    try:
        from sentence_transformers import SentenceTransformer
    except ImportError as error:
        raise IndexingError("sentence-transformers is not installed; pass another encoder") from error
    return SentenceTransformer(name, device=device, trust_remote_code=trust)


def check_encoder(encoder: Encoder, index_type: str) -> None:
    """The encoder must be of the index's kind and have one fixed positive width."""
    if encoder.kind != index_type:
        raise IndexingError(f"a {index_type} index needs a {index_type} encoder, not {encoder.kind}")
    d = encoder.dimension
    if isinstance(d, bool) or not isinstance(d, int) or d < 1:
        raise IndexingError("the encoder must have a fixed positive dimension")


def encode_column(
    rows: DataFrame, text: str, output: str, encoder: Encoder, batch_size: int = 32, query: bool = False
) -> DataFrame:
    """``rows`` with an encoded column; texts go to the encoder in batches of ``batch_size``.

    Queries go to the encoder's ``encode_query`` where it has one.
    """
    call = getattr(encoder, "encode_query", encoder.encode) if query else encoder.encode
    kind = "array<float>" if encoder.kind == "dense" else "array<array<float>>"

    @F.pandas_udf(kind)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            vectors: list[Any] = []
            texts = series.fillna("").tolist()
            for at in range(0, len(texts), batch_size):
                part = call(texts[at : at + batch_size])
                vectors += part
            if len(vectors) != len(texts):
                raise IndexingError("the encoder returned another number of rows than texts")
            yield pd.Series(vectors)

    return rows.withColumn(output, encode(F.col(text)))
