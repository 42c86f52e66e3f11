"""Archive datasets through an injected fetch function ``fetch(url) -> dict``.

The client pages through asset listings, follows only https links to allowed hosts, and resolves one asset
by id or path; the asset's file is then opened by ``opener(url)``."""

from __future__ import annotations

import json
from urllib.parse import urlsplit
from urllib.request import urlopen

from gridloom.array import ArrayMeta, SourceIdentity
from gridloom.exceptions import AmbiguousSelectionError, ObjectNotFoundError, SourceResolutionError, UnsupportedBackendError
from gridloom.sources.base import Asset, Source

# Fixed values of the archive's public interface.
API, HOSTS = "https://api.dandiarchive.org/api", ("api.dandiarchive.org",)
PAGE, MOST_PAGES = 100, 1000
DIGESTS = ("dandi:sha2-256", "dandi:dandi-zarr-checksum", "dandi:dandi-etag")


def checked(url: str) -> str:
    p = urlsplit(url)
    if p.scheme != "https" or p.hostname not in HOSTS:
        raise SourceResolutionError(f"refused address {p.scheme}://{p.hostname}")
    return url


def fetch_json(url: str) -> dict:
    with urlopen(checked(url), timeout=60) as r:  # noqa: S310
        return json.load(r)


def open_dandi(identifier: str | int, *, version: str | None = None, backend: str = "auto", storage_options: dict | None = None) -> ArchiveSource:
    return ArchiveSource(str(identifier), version, backend=backend, **(storage_options or {}))


class ArchiveSource(Source):
    capabilities = ("select", "inspect", "assets")

    def __init__(self, identifier: str, version: str | None = None, *, backend: str = "auto", fetch=fetch_json, opener=None):
        if not (identifier.isdigit() and len(identifier) <= 6):
            raise ValueError("a dataset id has one to six digits")
        if backend not in ("auto", "lindi", "remfile"):
            raise ValueError(f"unknown backend {backend!r}")
        self.id, self.version, self.fetch, self.opener = identifier.zfill(6), version or "draft", fetch, opener
        self.identity = SourceIdentity(f"DANDI:{self.id}", self.version)
        self._assets: list[Asset] | None = None

    def assets(self) -> list[Asset]:
        if self._assets is None:
            url = f"{API}/dandisets/{self.id}/versions/{self.version}/assets/?page_size={PAGE}&metadata=true"
            seen, out = set(), []
            while url:
                if url in seen or len(seen) >= MOST_PAGES:
                    raise SourceResolutionError("the asset listing doesn't end")
                seen.add(url)
                page = self.fetch(checked(url))
                for r in page.get("results", []):
                    digests = (r.get("metadata") or {}).get("digest", {})
                    out.append(Asset(r["asset_id"], r["path"], r.get("size"), next((f"{k.split(':')[1]}:{digests[k]}" for k in DIGESTS if k in digests), None)))
                url = page.get("next")
            self._assets = out
        return self._assets

    def resolve(self, asset: str | None) -> Asset:
        found = [a for a in self.assets() if asset is None or asset in (a.asset_id, a.path)]
        if not found:
            raise ObjectNotFoundError(f"no asset {asset!r}")
        if len(found) > 1:
            raise AmbiguousSelectionError("several assets: " + ", ".join(sorted(a.path for a in found)[:20]))
        return found[0]

    def objects(self) -> list[ArrayMeta]:
        raise UnsupportedBackendError("select an asset: its file lists the objects")

    def inspect(self):
        from gridloom.sources.base import Summary

        return Summary(self.identity, self.capabilities, tuple(self.assets()), ())

    def select(self, query=None, *, asset: str | None = None, **fields):
        asset = asset or (query.asset if query else None)
        chosen = self.resolve(asset)
        if self.opener is None:
            raise UnsupportedBackendError("reading archive files needs an opener for remote files")
        inner = self.opener(chosen)
        return inner.select(query, **fields) if query is None else inner.select(query)
