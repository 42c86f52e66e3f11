"""Partition manifests: one JSON file a finished partition, written last and by renaming."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans.execution import NAME

MOST_VERIFIED = 2 << 30


@dataclass(frozen=True)
class Manifest:
    partition_id: str
    workflow_id: str
    status: str
    outputs: dict[str, str] = field(default_factory=dict)
    checksums: dict[str, str] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)
    schema_version: str = "2"

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> Manifest:
        if d.get("status") not in ("complete", "failed"):
            raise ValueError("invalid partition status")
        parts = {k: d.get(k, {}) for k in ("outputs", "checksums", "sizes")}
        if not all(isinstance(v, dict) for v in parts.values()):
            raise ValueError("outputs, checksums and sizes are objects")
        if any(type(v) is not int or v < 0 for v in parts["sizes"].values()):
            raise ValueError("sizes are whole numbers, not negative")
        return cls(str(d["partition_id"]), str(d["workflow_id"]), d["status"], **parts, schema_version=str(d.get("schema_version", "1")))


def write_json(path: str, value) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(temporary, "w") as f:
        json.dump(value, f, sort_keys=True, separators=(",", ":"), allow_nan=False)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)


def read_json(path: str):
    with open(path) as f:
        return json.load(f)


def sha256(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while data := f.read(1 << 20):
            h.update(data)
    return h.hexdigest()


def safe_location(root: str, location: str) -> str:
    """The file of a manifest's location, which must stay below the result."""
    path = os.path.realpath(os.path.join(root, location))
    if os.path.isabs(location) or not path.startswith(os.path.realpath(root) + os.sep):
        raise ValueError(f"location {location!r} leaves the result")
    return path


def problem(root: str, data: dict, workflow_id: str, components: list[str], checksums: bool = True) -> str | None:
    """What is wrong with a partition, or None."""
    try:
        m = Manifest.from_dict(data)
        if m.status != "complete" or m.workflow_id != workflow_id:
            return "incomplete or of another workflow"
        names = {k.split(":")[0] for k in m.outputs}
        if names - set(components) or set(components) - names:
            return "undeclared or missing components"
        for key, location in m.outputs.items():
            if not NAME.fullmatch(key.split(":")[0]):
                return "unsafe component name"
            path = safe_location(root, location)
            if not os.path.isfile(path):
                return f"{location} is missing"
            size = os.path.getsize(path)
            if key in m.sizes and m.sizes[key] != size:
                return f"{location} has another size"
            if checksums:
                if size > MOST_VERIFIED:
                    return f"{location} is too large to verify"
                if sha256(path) != m.checksums.get(key):
                    return f"{location} has another checksum"
    except (ValueError, KeyError, TypeError) as e:
        return str(e)
    return None


def manifest_path(root: str, partition_id: str) -> str:
    return os.path.join(root, "manifests", re.sub(r"[^A-Za-z0-9_.-]", "_", partition_id) + ".json")


def check_one(root: str, key: str, workflow_id: str, components: list[str], checksums: bool = True) -> str | None:
    path = manifest_path(root, key)
    try:
        return problem(root, read_json(path), workflow_id, components, checksums) if os.path.exists(path) else "no manifest"
    except ValueError:
        return "unreadable manifest"


def check_all(spark: SparkSession, root: str, workflow_id: str, keys: list[str], components: list[str], checksums: bool = True) -> DataFrame:
    """(partition_id, problem): a distributed check of all partitions; null problems are valid."""
    rows = spark.createDataFrame([(k,) for k in keys], "partition_id string").repartition(max(1, min(len(keys), 256)))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids = b.column(0).to_pylist()
            out = [check_one(root, k, workflow_id, components, checksums) for k in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(out, pa.string())], ["partition_id", "problem"])

    return rows.mapInArrow(run, "partition_id string, problem string")
