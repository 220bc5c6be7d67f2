"""Experiments and benchmarks: parse, chunk, index, retrieve, evaluate.

Each stage is named by its configuration and the stage before, and written as
Parquet, so the next stage starts from files: lineage is cut at stage ends, and
with ``reuse`` a complete stage of the same name is read instead of run.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.errors import BenchmarkError, ExperimentError
from folioscope.functions.identity import aggregation_name, chunking_payload, digest, qrels_identity, query_set_identity, rows_identity
from folioscope.operators import chunking, evaluation, indexing, parsing, retrieval
from folioscope.operators.checks import query_conflicts, require
from folioscope.operators.encoders import Encoder, encode_column
from folioscope.session import checkpoint
from folioscope.plans.reports import comparison_table, metric_grid
from folioscope.sources import artifacts
from folioscope.sources.records import write_json_atomic, write_text_atomic


@dataclass(frozen=True)
class RetrievalConfig:
    top_k: int = 100
    aggregation: str | Callable = "max"

    def __post_init__(self) -> None:
        retrieval.check_top_k(self.top_k)
        if isinstance(self.aggregation, str) and self.aggregation not in retrieval.AGGREGATIONS:
            raise ExperimentError(f"aggregation must be one of {retrieval.AGGREGATIONS}")


@dataclass(frozen=True)
class EvaluationConfig:
    metrics: tuple[str, ...] = evaluation.FAMILIES
    k: tuple[int, ...] = (1, 5, 10)

    def __post_init__(self) -> None:
        evaluation.check_metrics(self.metrics)
        evaluation.check_cutoffs(self.k)


@dataclass(frozen=True)
class ExperimentConfig:
    parsing: parsing.ParsingConfig
    chunking: chunking.ChunkingConfig
    indexing: indexing.IndexingConfig
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    evaluation: EvaluationConfig = field(default_factory=EvaluationConfig)


@dataclass(frozen=True)
class ExperimentResult:
    experiment_hash: str
    artifacts: dict[str, str]
    metrics: dict[str, float]
    table: str


def experiment_payload(config: ExperimentConfig, nonce: str = "") -> dict[str, Any]:
    """The five configurations, whatever the collection."""
    return {
        "parsing": asdict(config.parsing),
        "chunking": chunking_payload(config.chunking.chunker_name, config.chunking.options, config.chunking.cache_key, nonce),
        "indexing": asdict(config.indexing),
        "retrieval": {"top_k": config.retrieval.top_k, "aggregation": aggregation_name(config.retrieval.aggregation)},
        "evaluation": {"metrics": list(config.evaluation.metrics), "k": list(config.evaluation.k)},
    }


def run_experiment(
    spark: SparkSession,
    root: str,
    pages: DataFrame,
    sources: DataFrame,
    queries: DataFrame,
    qrels: DataFrame,
    config: ExperimentConfig,
    encoder: Encoder,
    reuse: bool = False,
    retry_failed: bool = False,
) -> ExperimentResult:
    """All stages of one configuration; ``sources`` has ``doc_id, data, language``."""
    payloads = experiment_payload(config, nonce="run")
    depth = evaluation.check_cutoffs(config.evaluation.k, config.retrieval.top_k)
    used: dict[str, str] = {}

    def stage(name: str, payload: dict[str, Any], make: Callable[[], DataFrame], keep: bool = True) -> DataFrame:
        key = digest(payload)
        used[name] = key
        if not (reuse and keep and artifacts.state(root, name, key) == "complete"):
            artifacts.save(root, name, payload, {"data": make()})
        return artifacts.load(spark, root, name, payload)

    # the sources' digest is part of the name, so a changed document is parsed again
    bytes_of = sources.select("doc_id", F.sha2("data", 256).alias("sha"))
    source_identity = rows_identity(bytes_of, "doc_id", "sha").first()["identity"]
    p = {"parsing": payloads["parsing"], "sources": source_identity}

    def parse() -> DataFrame:
        return parsing.parse_collection(pages, sources, config.parsing)

    def parse_again(held: DataFrame) -> DataFrame:
        return parsing.parse_collection(pages, sources, config.parsing, held, retry_failed=True)

    parsed = stage("parsing", p, parse)
    if retry_failed and parsed.where("status = 'failed'").take(1):
        # the held rows are cut from the files that the new ones replace
        parsed = checkpoint(parse_again(parsed))
        artifacts.save(root, "parsing", p, {"data": parsed})
    parsing.require_complete(pages, parsed)
    c = {"chunking": payloads["chunking"], "parsing_hash": used["parsing"]}
    chunks = stage("chunking", c, lambda: chunking.chunk(parsed, config.chunking))
    i = {"indexing": payloads["indexing"], "chunking_hash": used["chunking"], "encoder": repr(encoder)}
    batch = config.indexing.options.get("batch_size", 32)
    dense = config.indexing.index_type == "dense"
    build = indexing.build_dense if dense else indexing.build_late
    if dense and "embedding" in chunks.columns:
        index = stage("indexing", i, lambda: build(chunks, None, model_name=config.indexing.model_name))
    else:
        index = stage("indexing", i, lambda: build(chunks, encoder, batch))
    if reuse and artifacts.state(root, "indexing", used["indexing"]) == "complete":
        apart = index.select("chunk_id").exceptAll(chunks.select("chunk_id")).unionByName(chunks.select("chunk_id").exceptAll(index.select("chunk_id")))
        require({"index and chunks differ": apart}, ExperimentError)
    require({"query": query_conflicts(queries)}, ExperimentError)
    r = {
        "retrieval": payloads["retrieval"],
        "unit": "pages",
        "index_hash": used["indexing"],
        "queries": query_set_identity(queries).first()["identity"],
    }
    asked = encode_column(queries, "text", "embedding" if dense else "tokens", encoder, batch, query=True)
    run = stage(
        "retrieval",
        r,
        lambda: retrieval.retrieve(
            index, asked, config.retrieval.top_k, config.retrieval.aggregation, config.indexing.index_type, contributors=True
        ),
    )
    evaluation.require_run(run, queries, pages)
    e = {"evaluation": payloads["evaluation"], "retrieval_hash": used["retrieval"], "qrels": qrels_identity(qrels).first()["identity"]}
    values = stage("evaluation", e, lambda: evaluation.metric_values(run, qrels, config.evaluation.metrics, depth))
    means = {f"{x['family']}@{x['k']}": x["value"] for x in evaluation.aggregate_metrics(values).collect()}
    if not means:
        raise ExperimentError("no query of the run is judged")
    table = metric_grid(means, evaluation.check_metrics(config.evaluation.metrics), depth)
    name = digest(payloads)
    home = artifacts.stage_path(root, "experiments", name)
    stages = {stage: artifacts.reference(root, stage, key) for stage, key in used.items()}
    write_json_atomic(f"{home}/result.json", {"experiment_hash": name, "stages": stages, "metrics": means})
    write_text_atomic(f"{home}/results.txt", table + "\n")
    return ExperimentResult(name, used, means, table)


def run_benchmark(
    spark: SparkSession,
    root: str,
    pages: DataFrame,
    sources: DataFrame,
    queries: DataFrame,
    qrels: DataFrame,
    experiments: Mapping[str, tuple[ExperimentConfig, Encoder]],
    reuse: bool = True,
) -> tuple[str, str, dict[str, ExperimentResult]]:
    """(hash, comparison table, results) of several experiments on one collection.

    All must ask for the same metrics and cutoffs.  Stages that experiments
    share are run once.  A failure names its experiment.
    """
    if not experiments or any(not str(label).strip() for label in experiments):
        raise BenchmarkError("experiments need labels")
    shared = {(tuple(c.evaluation.metrics), tuple(c.evaluation.k)) for c, _ in experiments.values()}
    if len(shared) != 1:
        raise BenchmarkError("all experiments must have the same metrics and cutoffs in the same order")
    results: dict[str, ExperimentResult] = {}
    for label, (config, encoder) in experiments.items():
        try:
            results[label] = run_experiment(spark, root, pages, sources, queries, qrels, config, encoder, reuse)
        except Exception as error:
            raise BenchmarkError(f"experiment {label!r} failed: {error}") from error
    metrics, ks = shared.pop()
    families, cutoffs = evaluation.check_metrics(metrics), evaluation.check_cutoffs(ks)
    table = comparison_table([(k, r.metrics) for k, r in results.items()], families, cutoffs)
    name = digest({"experiments": [[k, r.experiment_hash] for k, r in results.items()], "metrics": list(metrics), "k": list(ks)})
    home = artifacts.stage_path(root, "benchmarks", name)
    write_json_atomic(f"{home}/results.json", {k: r.metrics for k, r in results.items()})
    write_text_atomic(f"{home}/results.txt", table + "\n")
    return name, table, results
