"""Where results go, and the rules that keep them from harming anything."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

from gridloom.exceptions import OutputConflictError
from gridloom.sources.zarr import local_path


@dataclass(frozen=True)
class Output:
    uri: str
    mode: str = "create"
    compressor: str | None = None
    partition_on: tuple[str, ...] = ()
    kind = "array"

    def __post_init__(self):
        if self.mode not in ("create", "overwrite"):
            raise ValueError("mode is 'create' or 'overwrite'; appending isn't supported")
        if self.compressor not in (None, "default", "none", "zlib", "gzip"):
            raise ValueError(f"unknown compressor {self.compressor!r}")

    @property
    def root(self) -> str:
        return os.path.abspath(local_path(self.uri))

    @property
    def codec(self) -> str | None:
        return {"default": "zlib", "none": None}.get(self.compressor, self.compressor)


class ZarrOutput(Output):
    kind = "array"


class ParquetOutput(Output):
    kind = "table"


class SegmentationOutput(Output):
    kind = "segmentation"


def separate(root: str, inputs: list[str]) -> None:
    """An output neither is, nor holds, nor lies in an input."""
    out = Path(root).resolve()
    for i in inputs:
        if "://" in i and not i.startswith("file:"):
            continue
        source = Path(local_path(i)).resolve()
        if out == source or out in source.parents or source in out.parents:
            raise OutputConflictError(f"the output {root} and the input {i} overlap")


def guard_overwrite(root: str) -> None:
    path = Path(root).resolve()
    if path in (Path("/"), Path.home().resolve(), Path.cwd().resolve()) or len(path.parts) < 3 or path in Path.cwd().resolve().parents:
        raise OutputConflictError(f"refusing to delete {path}")
    if path.exists() and not (path / "provenance.json").exists() and any(path.iterdir()):
        raise OutputConflictError(f"{path} isn't a result of this library")
