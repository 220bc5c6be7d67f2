"""Stage results in folders named by their configuration, readable only when complete.

A result is written into a fresh folder of its artifact, and the manifest that
names this folder is written last; readers follow the manifest, so a result that
is replaced is whole at every moment, also where a store cannot rename folders.
All paths are URIs of Hadoop's file systems.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from folioscope.errors import ArtifactError
from folioscope.functions.identity import digest
from folioscope.sources import files
from folioscope.sources.records import write_json_atomic

STAGES = ("parsing", "chunking", "indexing", "retrieval", "evaluation", "experiments", "benchmarks")


def stage_path(root: str, stage: str, name: str) -> str:
    if stage not in STAGES:
        raise ArtifactError(f"unknown stage {stage!r}")
    return f"{str(root).rstrip('/')}/{stage}/{name}"


def state(root: str, stage: str, name: str) -> str:
    """complete (the manifest, written last, is there), partial or missing."""
    path = stage_path(root, stage, name)
    if files.is_file(f"{path}/manifest.json"):
        return "complete"
    return "partial" if files.exists(path) else "missing"


def save(root: str, stage: str, payload: dict[str, Any], tables: dict[str, DataFrame], replace: bool = True, partition_by: str | None = None) -> str:
    """Write the tables, then the manifest; returns the artifact's name."""
    name = digest(payload)
    path = stage_path(root, stage, name)
    if not replace and state(root, stage, name) == "complete":
        raise ArtifactError(f"{stage} {name} exists already")
    version = f"v-{uuid.uuid4().hex}"
    for table, rows in tables.items():
        writer = rows.write.mode("overwrite")
        if partition_by and partition_by in rows.columns:
            writer = writer.partitionBy(partition_by)
        writer.parquet(f"{path}/{version}/{table}")
    manifest = {"stage": stage, "hash": name, "payload": payload, "tables": sorted(tables), "version": version}
    write_json_atomic(f"{path}/manifest.json", manifest)
    for old in files.folders(path):
        if old.startswith("v-") and old != version:
            files.remove(f"{path}/{old}")
    return name


def load(spark: SparkSession, root: str, stage: str, payload: dict[str, Any], table: str = "data") -> DataFrame:
    """A table of a complete artifact of exactly this configuration."""
    name = digest(payload)
    path = stage_path(root, stage, name)
    found = state(root, stage, name)
    if found != "complete":
        raise ArtifactError(f"{stage} {name} is {found}")
    manifest = json.loads(files.read_text(f"{path}/manifest.json"))
    if manifest["payload"] != json.loads(json.dumps(payload)) or table not in manifest["tables"]:
        raise ArtifactError(f"{stage} {name} is of another configuration")
    return spark.read.parquet(f"{path}/{manifest['version']}/{table}")


def reference(root: str, stage: str, name: str) -> dict[str, str]:
    """Name and place of a complete artifact, for manifests of later stages."""
    if not isinstance(name, str) or not name.strip():
        raise ArtifactError(f"{stage} has no name")
    if state(root, stage, name) != "complete":
        raise ArtifactError(f"{stage} {name} is not complete")
    return {"hash": name, "path": stage_path(root, stage, name)}
