"""What a workflow will do, in numbers, before anything is read."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np

from gridloom.exceptions import AdapterCompatibilityError
from gridloom.expr import stable_hash
from gridloom.plans.partitions import Partition, check_chunks, check_cover, check_descriptors, check_halo, check_reduced, touched_chunks

NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")


def transport_bytes(touches: int | None, chunk_bytes: int | None, block: int | None) -> int | None:
    """Bytes that a transport of fixed blocks moves; None where a part isn't known."""
    if None in (touches, chunk_bytes, block):
        return None
    return touches * -(-chunk_bytes // block) * block


@dataclass(frozen=True)
class ExecutionPlan:
    workflow_id: str
    selected_shape: tuple[int, ...]
    output_shape: tuple[int, ...]
    output_axes: tuple[str, ...]
    dtype: str
    native_chunks: tuple[int, ...] | None
    partition_shape: tuple[int, ...]
    overlap: tuple[int, ...]
    task_count: int
    memory_per_task: int
    read_amplification: float
    logical_bytes_read: int
    chunks_touched: int | None
    total_bytes_read: int | None
    transport_bytes_read: int | None
    output_bytes: int | None
    source_size: int | None = None
    stages: tuple[dict, ...] = ()
    warnings: tuple[str, ...] = ()
    bounded: bool = True
    bounded_reasons: tuple[str, ...] = ()
    resources: dict = field(default_factory=dict)
    partitions: tuple[Partition, ...] = ()

    def to_dict(self) -> dict:
        """A report in which each number says whether it is estimated or unknown."""
        measured = ("source_size", "memory_per_task", "read_amplification", "logical_bytes_read", "chunks_touched", "total_bytes_read", "transport_bytes_read", "output_bytes")
        out = {k: getattr(self, k) for k in self.__dataclass_fields__ if k not in measured and k != "partitions"}
        out |= {k: {"status": "unknown" if getattr(self, k) is None else "estimated", "value": getattr(self, k)} for k in measured}
        return out | {"schema_version": "1", "partitions": [p.to_dict() for p in self.partitions]}

    def summary(self) -> str:
        return "\n".join([
            f"workflow {self.workflow_id[:16]}: {self.task_count} tasks of up to {self.memory_per_task} bytes",
            f"reads {self.logical_bytes_read} bytes (x {self.read_amplification:.2f}), {self.chunks_touched if self.chunks_touched is not None else 'unknown'} chunks",
            f"output {dict(zip(self.output_axes, self.output_shape))} {self.dtype}, {self.output_bytes} bytes",
            *(f"warning: {w}" for w in self.warnings),
        ])


def build_plan(meta, adapter, partition, output, block: int | None = None) -> ExecutionPlan:
    """Checks adapter, partition and output against the selection, and counts what will be done."""
    kinds = {"array": ("array", "blocks"), "table": ("table",), "segmentation": ("segmentation",)}
    if output.kind not in kinds.get(adapter.output.kind, ()):
        raise AdapterCompatibilityError(f"a {adapter.output.kind} doesn't go to a {output.kind} output")
    if not NAME.fullmatch(adapter.output.name):
        raise AdapterCompatibilityError(f"{adapter.output.name!r} is no component name")
    parts = partition.build(meta)
    check_descriptors(parts, meta.shape)
    retained = [i for i, a in enumerate(meta.axes) if a not in adapter.output.reduced_axes]
    check_reduced(parts, meta, adapter.output.reduced_axes)
    if adapter.output.kind != "table":
        check_cover(parts, meta.shape, retained)
    if adapter.output.chunks:
        check_chunks(parts, adapter.output.chunks, retained)
    check_halo(partition, adapter.requirements.requires_overlap)
    split = {a for p in parts for a, r, n in zip(meta.axes, p.output, meta.shape) if r != (0, n)}
    if adapter.requirements.splittable_axes is not None and split - set(adapter.requirements.splittable_axes):
        raise AdapterCompatibilityError(f"{adapter.name} can't be split along {sorted(split - set(adapter.requirements.splittable_axes))}")
    item = np.dtype(meta.dtype).itemsize
    sizes = [math.prod(b - a for a, b in p.read) for p in parts]
    selected = math.prod(meta.shape)
    touches = sum(touched_chunks(p.read, meta.bounds, meta.chunks) for p in parts) if meta.chunks else None
    chunk_bytes = math.prod(meta.chunks) * item if meta.chunks else None
    out_shape = tuple(meta.shape[i] for i in retained)
    notes = []
    if touches is not None and touches * chunk_bytes > 2 * selected * item:
        notes.append("partitions read more than twice the selected bytes in chunks; align them with the chunks")
    identity = {
        "source": [meta.source.uri, meta.source.version, meta.source.asset_id, meta.source.checksum], "path": meta.path, "bounds": [list(b) for b in meta.bounds],
        "dtype": np.dtype(meta.dtype).str, "adapter": adapter.identity(), "partition": partition.to_dict(),
        "output": {"kind": output.kind, "name": adapter.output.name, "dtype": str(adapter.output.dtype), "chunks": list(adapter.output.chunks or ())},
    }
    return ExecutionPlan(
        workflow_id=stable_hash(identity), selected_shape=meta.shape, output_shape=out_shape, output_axes=tuple(meta.axes[i] for i in retained),
        dtype=str(adapter.output.dtype), native_chunks=meta.chunks, partition_shape=tuple(max(p.output[i][1] - p.output[i][0] for p in parts) for i in range(len(meta.shape))),
        overlap=tuple(max(max(p.output[i][0] - p.read[i][0], p.read[i][1] - p.output[i][1]) for p in parts) for i in range(len(meta.shape))),
        task_count=len(parts), memory_per_task=adapter.memory(max(sizes) * item), read_amplification=sum(sizes) / selected, logical_bytes_read=sum(sizes) * item,
        chunks_touched=touches, total_bytes_read=None if touches is None else touches * chunk_bytes, transport_bytes_read=transport_bytes(touches, chunk_bytes, block),
        output_bytes=math.prod(out_shape) * np.dtype(adapter.output.dtype).itemsize if adapter.output.kind != "table" else None, warnings=tuple(notes), partitions=tuple(parts),
        resources=dict(adapter.requirements.resources), stages=tuple(adapter.stages()),
    )
