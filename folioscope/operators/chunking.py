"""Chunking strategies over whole documents, all documents in one plan.

A strategy maps a document's text to half-open code-point spans.  Strategies
that column functions can express never leave the JVM; the others run in Arrow
batches.  Whatever the strategy, spans are checked, those on no page dropped,
the rest numbered per document and named ``doc:%08d``.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.errors import ChunkingError
from folioscope.operators.checks import require, span_conflicts
from folioscope.operators.documents import document_texts, page_ranges, pages_of_span, reconstruct, usable_pages
from folioscope.operators.encoders import Encoder


@dataclass(frozen=True)
class ChunkSpan:
    """A piece of a document: content, place and metadata."""

    content: str
    start: int
    end: int
    metadata: dict[str, str] = field(default_factory=dict)
    embedding: list[float] | None = None


@dataclass(frozen=True)
class ChunkingConfig:
    """A strategy by name, with its options."""

    chunker_name: str
    options: dict[str, Any] = field(default_factory=dict)
    cache_key: str | None = None

    def __post_init__(self) -> None:
        if not isinstance(self.chunker_name, str) or not self.chunker_name.strip():
            raise ChunkingError("chunker_name must not be blank")
        if self.cache_key is not None and not str(self.cache_key).strip():
            raise ChunkingError("cache_key must not be blank")


SpanFunction = Callable[..., Iterable[Any]]
_REGISTRY: dict[str, SpanFunction] = {}


def register_chunker(*names: str, replace: bool = False) -> Callable[[SpanFunction], SpanFunction]:
    """Register a function ``(text, **options) -> spans or strings`` under one or more names."""

    def keep(function: SpanFunction) -> SpanFunction:
        for raw in names:
            name = raw.strip()
            if not name or name == "page":
                raise ChunkingError(f"{raw!r} cannot be registered")
            if not replace and _REGISTRY.get(name, function) is not function:
                raise ChunkingError(f"chunker {name!r} is registered already")
            _REGISTRY[name] = function
        return function

    return keep


def get_chunker(name: str) -> SpanFunction:
    try:
        return _REGISTRY[name.strip()]
    except KeyError:
        raise ChunkingError(f"unknown chunker {name!r}; known: {sorted(['page', *_REGISTRY])}") from None


def describe_chunker(name: str) -> dict[str, Any]:
    """Options of a strategy with defaults and types."""
    if name == "page":
        return {"name": "page", "options": {}, "accepts_additional_options": False, "description": "One chunk per usable page."}
    function = get_chunker(name)
    options, extra = {}, False
    for p in list(inspect.signature(function).parameters.values())[1:]:
        if p.kind is inspect.Parameter.VAR_KEYWORD:
            extra = True
            continue
        option: dict[str, Any] = {"required": p.default is inspect.Parameter.empty}
        if p.annotation is not inspect.Parameter.empty:
            option["type"] = p.annotation if isinstance(p.annotation, str) else inspect.formatannotation(p.annotation)
        if p.default is not inspect.Parameter.empty:
            option["default"] = p.default if isinstance(p.default, (bool, int, float, str, type(None))) else repr(p.default)
        options[p.name] = option
    text = (inspect.getdoc(function) or "").split("\n")[0]
    return {"name": name, "options": options, "accepts_additional_options": extra, "description": text}


def list_chunker_options(name: str) -> dict[str, dict[str, Any]]:
    return describe_chunker(name)["options"]


def _positive(**values: Any) -> None:
    for name, value in values.items():
        if isinstance(value, bool) or not isinstance(value, int) or value < 1:
            raise ChunkingError(f"{name} must be a positive integer")


@register_chunker("token")
def token_spans(text: str, chunk_size: int = 2048, chunk_overlap: int = 0, tokenizer: str = "character") -> Iterator[tuple[int, int]]:
    """Windows of a fixed size with an overlap, in characters or words."""
    _positive(chunk_size=chunk_size)
    if not 0 <= chunk_overlap < chunk_size:
        raise ChunkingError("chunk_overlap must be at least 0 and below chunk_size")
    if tokenizer == "character":
        units = None
        n = len(text)
    elif tokenizer == "word":
        units = [m.span() for m in re.finditer(r"\S+\s*", text)]
        n = len(units)
    else:
        raise ChunkingError(f"unknown tokenizer {tokenizer!r}")
    at = 0
    while at < n and (at == 0 or at + chunk_overlap < n):
        last = min(n, at + chunk_size)
        yield (at, last) if units is None else (units[at][0], units[last - 1][1])
        at += chunk_size - chunk_overlap


def sentence_bounds(text: str) -> list[tuple[int, int]]:
    """Sentences with the blanks behind them; together they cover the text."""
    out, at = [], 0
    for m in re.finditer(r"[.!?…]+[\"'»”)\]]*\s+|\n+", text):
        if m.end() > at:
            out.append((at, m.end()))
            at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


@register_chunker("sentence")
def sentence_spans(
    text: str, chunk_size: int = 2048, chunk_overlap: int = 0, min_sentences_per_chunk: int = 1
) -> Iterator[tuple[int, int]]:
    """Whole sentences packed up to a size; a chunk may start with the last sentences of the one before."""
    _positive(chunk_size=chunk_size, min_sentences_per_chunk=min_sentences_per_chunk)
    if not 0 <= chunk_overlap < chunk_size:
        raise ChunkingError("chunk_overlap must be at least 0 and below chunk_size")
    bounds = sentence_bounds(text)
    first = 0
    while first < len(bounds):
        last = first
        while last + 1 < len(bounds) and (
            bounds[last + 1][1] - bounds[first][0] <= chunk_size or last + 1 - first < min_sentences_per_chunk
        ):
            last += 1
        yield bounds[first][0], bounds[last][1]
        if last + 1 == len(bounds):
            return
        after = last + 1
        while after - 1 > first and bounds[last][1] - bounds[after - 1][0] <= chunk_overlap:
            after -= 1
        first = after


_LEVELS = (r"\n\s*\n", r"\n", r"(?<=[.!?…])\s+", r"\s+")


@register_chunker("recursive")
def recursive_spans(
    text: str, chunk_size: int = 2048, min_characters_per_chunk: int = 24, levels: tuple[str, ...] = _LEVELS
) -> list[tuple[int, int]]:
    """Split at the coarsest delimiter, split further what is too long, join what is too short."""
    _positive(chunk_size=chunk_size, min_characters_per_chunk=min_characters_per_chunk)

    def cut(start: int, end: int, level: int) -> list[tuple[int, int]]:
        if end - start <= chunk_size:
            return [(start, end)]
        if level == len(levels):
            return [(a, min(end, a + chunk_size)) for a in range(start, end, chunk_size)]
        edges = [start, *(m.end() for m in re.compile(levels[level]).finditer(text, start, end) if m.end() < end), end]
        parts: list[tuple[int, int]] = []
        for a, b in zip(edges, edges[1:]):
            if parts and parts[-1][1] == a and b - parts[-1][0] <= chunk_size:
                parts[-1] = (parts[-1][0], b)
            else:
                parts.append((a, b))
        return [p for a, b in parts for p in cut(a, b, level + 1)]

    out: list[tuple[int, int]] = []
    for a, b in cut(0, len(text), 0) if text else []:
        if out and b - a < min_characters_per_chunk and b - out[-1][0] <= chunk_size:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


@register_chunker("fast")
def fast_spans(text: str, chunk_size: int = 4096, delimiters: str = "\n.?") -> Iterator[tuple[int, int]]:
    """Windows of at most ``chunk_size`` bytes of UTF-8, cut behind the last delimiter they hold."""
    _positive(chunk_size=chunk_size)
    if chunk_size < 4:
        raise ChunkingError("chunk_size must hold any character: at least 4 bytes")
    ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in text]) if text else np.zeros(0, dtype=int)
    at = 0
    while at < len(text):
        used = int(ends[at - 1]) if at else 0
        last = int(np.searchsorted(ends, used + chunk_size, side="right"))
        if last < len(text):
            found = max((text.rfind(d, at, last) for d in delimiters), default=-1)
            if found >= at:
                last = found + 1
        yield at, last
        at = last


@register_chunker("semantic")
def semantic_spans(
    text: str, encoder: Encoder, threshold: float = 0.8, chunk_size: int = 2048, similarity_window: int = 3, skip_window: int = 0
) -> list[tuple[int, int]]:
    """Sentences grouped while each is similar to the mean of those before it.

    With ``skip_window`` a group is also joined to a similar one that many
    groups earlier, with all between them.
    """
    _positive(chunk_size=chunk_size, similarity_window=similarity_window)
    bounds = sentence_bounds(text)
    if not bounds:
        return []
    vectors = np.asarray(encoder.encode([text[a:b] for a, b in bounds]), dtype=float)

    def alike(left: np.ndarray, right: np.ndarray) -> bool:
        size = np.linalg.norm(left) * np.linalg.norm(right)
        return bool(size > 0 and left @ right / size >= threshold)

    groups = [[0]]
    for i in range(1, len(bounds)):
        near = vectors[groups[-1][-similarity_window:]].mean(axis=0)
        fits = bounds[i][1] - bounds[groups[-1][0]][0] <= chunk_size
        if fits and alike(near, vectors[i]):
            groups[-1].append(i)
        else:
            groups.append([i])
    if skip_window:
        merged = groups[:1]
        for group in groups[1:]:
            for back in range(min(skip_window + 1, len(merged)), 1, -1):
                if alike(vectors[merged[-back]].mean(axis=0), vectors[group].mean(axis=0)):
                    if bounds[group[-1]][1] - bounds[merged[-back][0]][0] <= chunk_size:
                        merged[-back:] = [sum(merged[-back:], []) + group]
                        break
            else:
                merged.append(group)
        groups = merged
    return [(bounds[g[0]][0], bounds[g[-1]][1]) for g in groups]


@register_chunker("late")
def late_spans(
    text: str, encoder: Encoder, embedding_model: str = "", chunk_size: int = 2048, min_characters_per_chunk: int = 24
) -> Iterator[ChunkSpan]:
    """Recursive chunks that carry the mean of their words' vectors, encoded in the document's context."""
    spans = recursive_spans(text, chunk_size, min_characters_per_chunk)
    words = [m.span() for m in re.finditer(r"[^\W_]+", text)]
    if not words:
        return
    matrix = np.asarray(encoder.encode([text])[0], dtype=float)
    if len(matrix) != len(words):
        raise ChunkingError("a late chunker needs an encoder with one vector per word")
    starts = np.array([a for a, _ in words])
    for a, b in spans:
        inside = (starts >= a) & (starts < b)
        pooled = matrix[inside].mean(axis=0) if inside.any() else matrix.mean(axis=0)
        yield ChunkSpan(text[a:b], a, b, {"embedding_model": embedding_model}, pooled.tolist())


@register_chunker("neural")
def neural_spans(text: str, predictor: Callable[[str], Iterable[int]], min_characters_per_chunk: int = 10) -> list[tuple[int, int]]:
    """Cuts where a boundary predictor says so; chunks that would be too short are joined."""
    _positive(min_characters_per_chunk=min_characters_per_chunk)
    out: list[tuple[int, int]] = []
    edges = [0, *sorted({int(p) for p in predictor(text) if 0 < p < len(text)}), len(text)]
    for a, b in zip(edges, edges[1:]):
        if b <= a:
            continue
        if out and (b - a < min_characters_per_chunk or out[-1][1] - out[-1][0] < min_characters_per_chunk):
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def normalize_spans(text: str, produced: Iterable[Any]) -> list[ChunkSpan]:
    """Checked spans from strings, (start, end) pairs, mappings or :class:`ChunkSpan`.

    A string is sought from the end of the chunk before; spans must be in the
    text, not empty, and equal to their slice.
    """
    if isinstance(produced, (str, bytes)):
        raise ChunkingError("a chunker must return several chunks, not one string")
    out: list[ChunkSpan] = []
    at = 0
    for item in produced:
        if isinstance(item, str):
            start = text.find(item, at) if item else -1
            if start < 0:
                raise ChunkingError("a chunk is empty or not in the text behind the one before")
            span = ChunkSpan(item, start, start + len(item))
            at = span.end
        elif isinstance(item, Mapping):
            span = ChunkSpan(item["content"], item["start"], item["end"], {k: str(v) for k, v in item.get("metadata", {}).items()})
        elif isinstance(item, ChunkSpan):
            span = item
        else:
            start, end = item
            span = ChunkSpan(text[start:end], start, end)
        for value in (span.start, span.end):
            if isinstance(value, bool) or not isinstance(value, (int, np.integer)):
                raise ChunkingError("span offsets must be integers")
        if not (span.content and 0 <= span.start < span.end <= len(text)):
            raise ChunkingError(f"span [{span.start}, {span.end}) is empty or outside the text")
        if text[span.start : span.end] != span.content:
            raise ChunkingError(f"span [{span.start}, {span.end}) is not equal to its slice")
        out.append(span)
    return out


_SPANS = "doc_id string, place int, start int, end int, content string, metadata map<string,string>, embedding array<float>"


def _number(spans: DataFrame) -> DataFrame:
    """Drop spans on no page, number the rest by place, and name them."""
    kept = spans.where(F.size("page_ids") > 0)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("place")) - 1
    named = F.format_string("%s:%08d", F.col("doc_id"), number)
    return kept.withColumn("chunk_id", named)


def page_chunks(parsed: DataFrame) -> DataFrame:
    """One chunk per usable page; ``start`` and ``end`` are those of the page itself."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "page_id")) - 1
    return usable_pages(parsed).select(
        F.format_string("%s:%08d", F.col("doc_id"), number).alias("chunk_id"),
        "doc_id",
        F.array("page_id").alias("page_ids"),
        "content",
        F.lit(0).alias("start"),
        F.length("content").alias("end"),
        F.create_map(F.lit("strategy"), F.lit("page")).alias("metadata"),
    )


def window_chunks(documents: DataFrame, chunk_size: int, chunk_overlap: int = 0) -> DataFrame:
    """Character windows by column functions alone: ``documents(doc_id, text, page_ranges)``."""
    _positive(chunk_size=chunk_size)
    if not 0 <= chunk_overlap < chunk_size:
        raise ChunkingError("chunk_overlap must be at least 0 and below chunk_size")
    step = chunk_size - chunk_overlap
    # the text is cut once, from front to back; a window is its block and the beginning of those behind it
    blocks = documents.where(F.length("text") > 0).select(
        "doc_id", "page_ranges", F.length("text").alias("n"), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("blocks")
    )
    last = F.greatest(F.col("n") - chunk_overlap - 1, F.lit(0))
    several = -(-chunk_size // step)

    def window(start: Column, place: Column) -> Column:
        end = F.least(start + chunk_size, F.col("n"))
        text = F.substring(F.array_join(F.slice("blocks", place + 1, F.lit(several)), ""), 1, chunk_size)
        pages = pages_of_span(F.col("page_ranges"), start, end)
        return F.struct(place.alias("place"), start.alias("start"), end.alias("end"), text.alias("content"), pages.alias("page_ids"))

    windows = F.transform(F.sequence(F.lit(0), last, F.lit(step)), window)
    # outer, as the optimizer would make an inner one's array once more to test it; no text here is empty
    placed = blocks.select("doc_id", F.explode_outer(windows).alias("w")).select(
        "doc_id", "w.*", F.create_map(F.lit("strategy"), F.lit("token")).alias("metadata")
    )
    return _number(placed).select("chunk_id", "doc_id", "page_ids", "content", "start", "end", "metadata")


class DocumentChunker:
    """A strategy with full control: from a table of documents to a table of spans.

    Registered as an instance; ``chunk_documents`` gives ``doc_id, place, start,
    end`` and optionally ``metadata`` (a map of strings) for ``doc_id, text``.
    Contents, checks, pages and names follow as for any strategy.
    """

    def check_options(self, options: Mapping[str, Any]) -> None:
        """Raise where the options are wrong."""

    def chunk_documents(self, documents: DataFrame, options: Mapping[str, Any]) -> DataFrame:
        raise NotImplementedError


def _controlled(chunker: DocumentChunker, name: str, documents: DataFrame, options: Mapping[str, Any]) -> DataFrame:
    chunker.check_options(options)
    made = chunker.chunk_documents(documents, options)
    told = F.map_concat(F.create_map(F.lit("strategy"), F.lit(name)), F.col("metadata") if "metadata" in made.columns else F.create_map().cast("map<string,string>"))
    spans = made.join(documents, "doc_id", "left").select(
        "doc_id", "place", "start", "end", "text", told.alias("metadata"), F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("content")
    )
    require({"span": span_conflicts(spans.withColumn("content", F.coalesce("content", F.lit("")))).select("doc_id", "start", "end")}, ChunkingError)
    return spans.drop("text")


def chunk(parsed: DataFrame, config: ChunkingConfig) -> DataFrame:
    """``chunk_id, doc_id, page_ids, content, start, end, metadata`` (and ``embedding`` for late) of all documents."""
    options = dict(config.options)
    if config.chunker_name == "page":
        if options:
            raise ChunkingError("the page strategy takes no options")
        return page_chunks(parsed)
    if config.chunker_name == "token" and options.get("tokenizer", "character") == "character":
        options.pop("tokenizer", None)
        return window_chunks(reconstruct(parsed), options.get("chunk_size", 2048), options.get("chunk_overlap", 0))
    documents = document_texts(parsed)
    function, name = get_chunker(config.chunker_name), config.chunker_name
    if isinstance(function, DocumentChunker):
        return _placed(_controlled(function, name, documents, options), parsed)
    try:
        inspect.signature(function).bind("", **options)
    except TypeError as error:
        raise ChunkingError(f"options of {name!r}: {error}; see describe_chunker({name!r})") from error

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, text in zip(frame["doc_id"], frame["text"]):
                for place, s in enumerate(normalize_spans(text, function(text, **options))):
                    out.append((doc, place, int(s.start), int(s.end), s.content, {"strategy": name, **s.metadata}, s.embedding))
            yield pd.DataFrame(out, columns=["doc_id", "place", "start", "end", "content", "metadata", "embedding"])

    spans = documents.mapInPandas(cut, _SPANS)
    return _placed(spans if name == "late" else spans.drop("embedding"), parsed)


def _placed(spans: DataFrame, parsed: DataFrame) -> DataFrame:
    """Spans with the pages they lie on, numbered and named."""
    placed = spans.join(page_ranges(parsed), "doc_id").withColumn("page_ids", pages_of_span(F.col("page_ranges"), F.col("start"), F.col("end")))
    columns = ["chunk_id", "doc_id", "page_ids", "content", "start", "end", "metadata"]
    return _number(placed).select(*columns, *(["embedding"] if "embedding" in spans.columns else []))
