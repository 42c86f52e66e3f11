"""Array sources: stores, files and archives that yield metadata and lazily read cells."""

from gridloom.sources.base import Query, Source, find, open_source

__all__ = ["Query", "Source", "find", "open_source"]
