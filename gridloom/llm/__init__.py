"""Operators for large text-corpus pipelines (sharding, quality, deduplication, packing, ...)."""
