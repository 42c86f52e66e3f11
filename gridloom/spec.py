"""Portable workflow files: one expression workflow as JSON, without code."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import numpy as np

from gridloom import __version__, expr
from gridloom.array import NamedArray, Selection
from gridloom.exceptions import WorkflowSpecError
from gridloom.storage.outputs import ZarrOutput

LARGEST = 5 << 20
FIELDS = ("schema_version", "kind", "source", "selection", "expression", "output", "execution", "provenance")


def _no_twins(pairs):
    out = {}
    for k, v in pairs:
        if k in out:
            raise WorkflowSpecError(f"key {k!r} occurs twice")
        out[k] = v
    return out


@dataclass(frozen=True)
class WorkflowSpec:
    data: dict

    @classmethod
    def from_array(cls, array: NamedArray, output: str, *, compressor: str | None = None, memory_limit=None, max_workers: int | None = None, chunks=None) -> WorkflowSpec:
        m = array.metadata
        return cls.from_dict({
            "schema_version": "1", "kind": "numpy-expression",
            "source": {"uri": m.source.uri, "version": m.source.version, "asset_id": m.source.asset_id, "checksum": m.source.checksum, "backend": m.attributes.get("backend")},
            "selection": {"path": m.path, "bounds": [list(b) for b in m.bounds], "shape": list(m.shape), "axes": list(m.axes), "dtype": np.dtype(m.dtype).str, "chunks": list(m.chunks) if m.chunks else None},
            "expression": expr.to_dict(array.expression),
            "output": {"type": "zarr", "uri": output, "mode": "create", "compressor": compressor, "chunks": list(chunks) if chunks else None},
            "execution": {"memory_limit": memory_limit, "max_workers": max_workers},
            "provenance": {"generated_by": {"name": "gridloom", "version": __version__}, "expression_id": expr.identity(array.expression)},
        })

    @classmethod
    def from_dict(cls, d) -> WorkflowSpec:
        if not isinstance(d, dict) or set(d) != set(FIELDS):
            raise WorkflowSpecError(f"a workflow file has exactly the fields {', '.join(FIELDS)}")
        if d["schema_version"] != "1" or d["kind"] != "numpy-expression":
            raise WorkflowSpecError("unsupported version or kind")
        try:
            e = expr.from_dict(d["expression"])
            if d["output"]["type"] != "zarr" or d["output"]["mode"] != "create":
                raise WorkflowSpecError("a workflow file creates a zarr output and never overwrites")
            s = d["selection"]
            if not len(s["bounds"]) == len(s["shape"]) == len(s["axes"]) or [b - a for a, b in s["bounds"]] != s["shape"]:
                raise WorkflowSpecError("bounds and shape disagree")
            inputs = [x for x in _nodes(e) if isinstance(x, expr.Input)]
            if not inputs or any((list(x.shape), list(x.axes), x.dtype.str) != (s["shape"], s["axes"], s["dtype"]) for x in inputs):
                raise WorkflowSpecError("the expression's input isn't the selection")
        except (KeyError, TypeError, ValueError) as error:
            if isinstance(error, WorkflowSpecError):
                raise
            raise WorkflowSpecError(str(error)) from error
        return cls(d)

    @classmethod
    def from_json(cls, path: str) -> WorkflowSpec:
        if os.path.getsize(path) > LARGEST:
            raise WorkflowSpecError("the file is too large")
        with open(path) as f:
            try:
                return cls.from_dict(json.load(f, object_pairs_hook=_no_twins))
            except json.JSONDecodeError as error:
                raise WorkflowSpecError(f"no JSON: {error}") from error

    def to_json(self, path: str, overwrite: bool = False) -> None:
        if os.path.islink(path) or (os.path.exists(path) and not overwrite):
            raise WorkflowSpecError(f"{path} exists")
        with open(path, "w") as f:
            json.dump(self.data, f, indent=2, sort_keys=True, allow_nan=False)

    def array(self, spark=None) -> NamedArray:
        """The workflow's expression over its source, every recorded property checked."""
        from gridloom.sources import open_source

        want, source = self.data["selection"], self.data["source"]
        opened = open_source(source["uri"], version=source["version"])
        if source["checksum"] and opened.identity.checksum != source["checksum"]:
            raise WorkflowSpecError("the source has changed")
        chosen: Selection = opened.select(path=want["path"], asset=source["asset_id"])
        if len(chosen.metadata.axes) != len(want["axes"]) or list(chosen.metadata.axes) != want["axes"]:
            raise WorkflowSpecError("the source's axes differ")
        part = chosen.isel(**{a: slice(*b) for a, b in zip(want["axes"], want["bounds"])})
        m = part.metadata
        if list(m.shape) != want["shape"] or np.dtype(m.dtype).str != want["dtype"] or (want["chunks"] and list(m.chunks or ()) != want["chunks"]) or m.attributes.get("backend") != source["backend"]:
            raise WorkflowSpecError("the selection differs in shape, dtype, chunks or backend")
        return NamedArray(part, expr.from_dict(self.data["expression"]), spark)

    def workflow(self, output: str | None = None, spark=None):
        from gridloom.run import persist_workflow

        o = self.data["output"]
        how = {k: v for k, v in self.data["execution"].items() if v is not None}
        return persist_workflow(self.array(spark), ZarrOutput(output or o["uri"], compressor=o["compressor"]), chunks=tuple(o["chunks"]) if o["chunks"] else None, **how)

    def plan(self, spark=None):
        return self.workflow(spark=spark).plan

    def reproduce(self, output: str | None = None, spark=None):
        return self.workflow(output, spark).execute()


def _nodes(x):
    yield x
    for c in expr.children(x):
        yield from _nodes(c)


def reproduce(spec: WorkflowSpec | str, output: str | None = None, spark=None):
    return (WorkflowSpec.from_json(spec) if isinstance(spec, str) else spec).reproduce(output, spark)
