"""Sources: discovery of objects and selection of exactly one of them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import urlsplit, urlunsplit

from pyspark.sql import DataFrame, SparkSession

from gridloom.array import ArrayMeta, Selection, SourceIdentity
from gridloom.exceptions import AmbiguousSelectionError, ObjectNotFoundError


@dataclass(frozen=True)
class SourceSpec:
    uri: str
    version: str | None = None
    storage_options: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Asset:
    asset_id: str
    path: str
    size: int | None = None
    checksum: str | None = None


@dataclass(frozen=True)
class Summary:
    identity: SourceIdentity
    capabilities: tuple[str, ...]
    assets: tuple[Asset, ...]
    objects: tuple[ArrayMeta, ...]


@dataclass(frozen=True)
class Query:
    """All fields given must match; ``neurodata_type`` matches any class of an object's hierarchy."""

    name: str | None = None
    path: str | None = None
    neurodata_type: str | None = None
    asset: str | None = None
    subject: str | None = None
    session_id: str | None = None
    where: dict[str, Any] = field(default_factory=dict)

    def matches(self, m: ArrayMeta) -> bool:
        return (
            (self.name is None or m.name == self.name)
            and (self.path is None or m.path.rstrip("/") == self.path.rstrip("/"))
            and (self.neurodata_type is None or self.neurodata_type in (m.neurodata_type, *m.type_hierarchy))
            and (self.asset is None or self.asset in (m.source.asset_id, m.attributes.get("asset_path")))
            and (self.subject is None or m.subject == self.subject)
            and (self.session_id is None or m.session_id == self.session_id)
            and all(m.attributes.get(k) == v for k, v in self.where.items())
        )


def find(objects, query: Query) -> ArrayMeta:
    found = [m for m in objects if query.matches(m)]
    if not found:
        raise ObjectNotFoundError(f"nothing matches {query}")
    if len(found) > 1:
        raise AmbiguousSelectionError("several objects match: " + ", ".join(sorted(m.path for m in found)))
    return found[0]


class Source:
    """What all sources share. Subclasses give ``identity``, ``objects()`` and ``_reader(meta)``."""

    identity: SourceIdentity
    capabilities: tuple[str, ...] = ("select", "inspect")

    def objects(self) -> list[ArrayMeta]:
        raise NotImplementedError

    def assets(self) -> list[Asset]:
        return [Asset(self.identity.uri, self.identity.uri)]

    def _reader(self, meta: ArrayMeta):
        raise NotImplementedError

    def _times(self, meta: ArrayMeta):
        return None

    def _block(self, meta: ArrayMeta):
        return None

    def select(self, query: Query | None = None, **fields) -> Selection:
        meta = find(self.objects(), query or Query(**fields))
        return Selection(meta, self._reader(meta), self._times(meta), self._block(meta))

    def inspect(self) -> Summary:
        return Summary(self.identity, self.capabilities, tuple(self.assets()), tuple(self.objects()))

    def objects_table(self, spark: SparkSession) -> DataFrame:
        """The catalogue as a DataFrame."""
        rows = [(m.path, m.name, m.neurodata_type, list(m.shape), m.dtype.str, list(m.chunks or ()), list(m.axes)) for m in self.objects()]
        return spark.createDataFrame(rows, "path string, name string, neurodata_type string, shape array<long>, dtype string, chunks array<long>, axes array<string>")

    def io_counters(self) -> dict[str, int | None]:
        """Responses and bytes of the transport; None where it has no counter."""
        return {"responses": None, "bytes": None}

    def close(self) -> None:
        pass

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


def redacted(uri: str) -> str:
    """An address without credentials, query and fragment."""
    p = urlsplit(uri)
    return urlunsplit((p.scheme, p.hostname + (f":{p.port}" if p.port else "") if p.hostname else "", p.path, "", "")) if p.scheme and p.netloc else uri


ARCHIVE = re.compile(r"DANDI:(\d{1,6})(?:@([\w.]+))?")


def open_source(source: str, *, version: str | None = None, storage_options: dict | None = None) -> Source:
    """An archive id (``DANDI:NNNNNN[@version]``), an .nwb file or a Zarr store."""
    from gridloom.sources.archive import ArchiveSource
    from gridloom.sources.hdf5 import Hdf5Source
    from gridloom.sources.zarr import ZarrSource

    if m := ARCHIVE.fullmatch(source):
        if m[2] and version and m[2] != version:
            raise ValueError(f"versions {m[2]} and {version} conflict")
        return ArchiveSource(m[1], version or m[2], **(storage_options or {}))
    if version is not None:
        raise ValueError("only archive sources have versions")
    if urlsplit(source).path.endswith(".nwb"):
        return Hdf5Source(source, **(storage_options or {}))
    if storage_options:
        raise ValueError(f"unknown storage options {sorted(storage_options)}")
    return ZarrSource(source)
