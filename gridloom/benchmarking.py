"""Benchmark records: a strict JSON schema in which null means not measured."""

from __future__ import annotations

import json
import math

CLASSES = ("publication", "current", "historical")
# Fields of a record and their types (None: may be null).
SCHEMA = {
    "name": (str,), "classification": (str,), "config": (dict,), "wall_seconds": (float, int, None), "peak_rss_bytes": (int, None),
    "bytes_read": (int, None), "valid": (bool, None), "environment": (dict,), "notes": (str, None),
}


def validate(record: dict) -> dict:
    if set(record) != set(SCHEMA):
        raise ValueError(f"a record has exactly the fields {', '.join(SCHEMA)}")
    for k, kinds in SCHEMA.items():
        v = record[k]
        if v is None and None in kinds:
            continue
        if not isinstance(v, tuple(t for t in kinds if t)) or (isinstance(v, bool) and bool not in kinds):
            raise ValueError(f"{k} has the wrong type")
        if isinstance(v, float) and not math.isfinite(v):
            raise ValueError(f"{k} isn't finite")
    if record["classification"] not in CLASSES:
        raise ValueError(f"classification is one of {CLASSES}")
    json.dumps(record, allow_nan=False)
    return record


def tables(records: list[dict], classification: str) -> tuple[str, str]:
    """(markdown, csv) of the records of one class."""
    columns = ("name", "wall_seconds", "peak_rss_bytes", "bytes_read", "valid")
    rows = [[("" if r[c] is None else str(r[c])) for c in columns] for r in records if validate(r)["classification"] == classification]
    head = list(columns)
    markdown = "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * len(head), *rows])
    return markdown, "\n".join(",".join(r) for r in [head, *rows])
