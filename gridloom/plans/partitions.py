"""Partitions: what a task reads and which part of its result it owns. Metadata only."""

from __future__ import annotations

import itertools
import math
import warnings
from bisect import bisect_left
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from gridloom.exceptions import PartitionValidationError

Range = tuple[int, int]


@dataclass(frozen=True)
class Partition:
    """Half-open ranges by axis: ``read`` of the input, ``output`` owned, ``trim`` within the read part."""

    key: str
    read: tuple[Range, ...]
    output: tuple[Range, ...]
    trim: tuple[Range, ...]
    coordinates: tuple[tuple[str, int | str], ...] = ()

    def to_dict(self) -> dict:
        return {"key": self.key, "read": [list(r) for r in self.read], "output": [list(r) for r in self.output], "trim": [list(r) for r in self.trim], "coordinates": dict(self.coordinates)}

    @classmethod
    def from_dict(cls, d: dict) -> Partition:
        def ranges(name):
            out = []
            for r in d[name]:
                if len(r) not in (2, 3) or (len(r) == 3 and r[2] not in (1, None)):
                    raise PartitionValidationError(f"{name} ranges have step 1")
                if any(type(v) is not int for v in r[:2]) or not 0 <= r[0] < r[1]:
                    raise PartitionValidationError(f"{name} has an invalid range {r}")
                out.append((r[0], r[1]))
            return tuple(out)

        return cls(str(d["key"]), ranges("read"), ranges("output"), ranges("trim"), tuple(dict(d.get("coordinates", {})).items()))


@dataclass(frozen=True)
class Report:
    valid: bool
    errors: tuple[str, ...] = ()
    warnings: tuple[str, ...] = ()


class Plan:
    """What partition plans share: ``build(meta)`` raises what ``validate(meta)`` reports."""

    def build(self, meta) -> list[Partition]:
        raise NotImplementedError

    def validate(self, meta) -> Report:
        """Errors and warnings of this plan for an array, and of the partitions that it makes."""
        with warnings.catch_warnings(record=True) as seen:
            warnings.simplefilter("always")
            try:
                parts = self.build(meta)
                check_descriptors(parts, meta.shape)
                check_cover(parts, meta.shape)
                errors: tuple[str, ...] = ()
            except PartitionValidationError as e:
                errors = (str(e),)
        return Report(not errors, errors, tuple(str(w.message) for w in seen))


def _windows(n: int, size: int, before: int, after: int) -> list[tuple[Range, Range, Range]]:
    """(read, output, trim) of windows that tile 0 .. n."""
    out = []
    for start in range(0, n, size):
        stop = min(n, start + size)
        low, high = max(0, start - before), min(n, stop + after)
        out.append(((low, high), (start, stop), (start - low, stop - low)))
    return out


def _cross(shape, by_axis: list[list[tuple[Range, Range, Range]]], label: str, names) -> list[Partition]:
    out = []
    for i, parts in enumerate(itertools.product(*by_axis)):
        coordinates = tuple((f"{a}_start", p[1][0]) for a, p in zip(names, parts))
        out.append(Partition(f"{label}-{i:06d}", *(tuple(p[k] for p in parts) for k in range(3)), coordinates))
    return out


#: Units of durations and how many of them make a second.
PER_SECOND = {"ms": 1000, "s": 1, "min": Fraction(1, 60)}


def samples(value: int | str, rate: float | None) -> int:
    """A number of samples, given as such or as a duration ("60 s", "5 ms", "2 min") of one sample at least."""
    if type(value) is int:
        return value
    text = str(value).strip()
    unit = next((u for u in PER_SECOND if text.endswith(u) and text[: -len(u)].strip().replace(".", "", 1).isdecimal() and not text[: -len(u)].strip().startswith(".") and not text[: -len(u)].strip().endswith(".")), None)
    if isinstance(value, bool) or unit is None:
        raise PartitionValidationError(f"{value!r} is neither a number of samples nor a duration")
    if not rate:
        raise PartitionValidationError("durations need a sampling rate")
    seconds = Fraction(text[: -len(unit)].strip()) / PER_SECOND[unit]
    return max(1, round(seconds * Fraction(rate)))


@dataclass(frozen=True)
class TimeWindowPlan(Plan):
    """Tumbling windows of the ``time`` axis (or the first), read with an overlap on both sides."""

    size: int | str
    overlap: int | str = 0
    units: str = "samples"
    align_to: str | None = None

    def build(self, meta) -> list[Partition]:
        at = meta.axes.index("time") if "time" in meta.axes else 0
        if self.align_to == "timestamps" and meta.timestamps_path:
            raise PartitionValidationError("windows can't be aligned to irregular timestamps")
        size, overlap = samples(self.size, meta.rate), samples(self.overlap, meta.rate) if self.overlap else 0
        if size <= 0 or overlap < 0 or overlap >= size:
            raise PartitionValidationError("a window must be positive and larger than its overlap")
        if size > meta.shape[at]:
            warnings.warn("the window is larger than its axis", stacklevel=2)
        by_axis = [_windows(n, size, overlap, overlap) if i == at else [((0, n), (0, n), (0, n))] for i, n in enumerate(meta.shape)]
        return _cross(meta.shape, by_axis, "window", meta.axes)

    def to_dict(self) -> dict:
        return {"type": "time", "size": self.size, "overlap": self.overlap, "units": self.units, "align_to": self.align_to}


@dataclass(frozen=True)
class SpatialTilePlan(Plan):
    """Tiles of the named axes, read with a halo; other axes are whole."""

    tile: dict[str, int]
    halo: dict[str, int] = field(default_factory=dict)

    def build(self, meta) -> list[Partition]:
        for a in (*self.tile, *self.halo):
            if a not in meta.axes:
                raise PartitionValidationError(f"no axis {a!r} among {meta.axes}")
        by_axis = []
        for a, n in zip(meta.axes, meta.shape):
            size, halo = self.tile.get(a, n), self.halo.get(a, 0)
            if size <= 0 or halo < 0:
                raise PartitionValidationError("tiles are positive and halos not negative")
            by_axis.append(_windows(n, size, halo, halo))
        return _cross(meta.shape, by_axis, "tile", meta.axes)

    def numbered(self, meta):
        """The function from a partition's number to the partition, for plans without halos."""
        sizes = [self.tile.get(a, n) for a, n in zip(meta.axes, meta.shape)]
        counts, shape, names = [-(-n // s) for n, s in zip(meta.shape, sizes)], tuple(meta.shape), tuple(meta.axes)

        def at(number: int) -> Partition:
            place, rest = [], number
            for c in reversed(counts):
                rest, k = divmod(rest, c)
                place.append(k)
            own = tuple((k * s, min(n, (k + 1) * s)) for k, s, n in zip(reversed(place), sizes, shape))
            return Partition(f"tile-{number:06d}", own, own, tuple((0, b - a) for a, b in own), tuple((f"{a}_start", o[0]) for a, o in zip(names, own)))

        return at

    def to_dict(self) -> dict:
        return {"type": "tile", "tile": dict(self.tile), "halo": dict(self.halo)}


@dataclass(frozen=True)
class AssetPlan(Plan):
    """One whole partition; ``filter`` is recorded only."""

    filter: str | None = None

    def build(self, meta) -> list[Partition]:
        whole = tuple((0, n) for n in meta.shape)
        return [Partition("asset-000000", whole, whole, whole)]

    def to_dict(self) -> dict:
        return {"type": "asset", "filter": self.filter}


@dataclass(frozen=True)
class SessionPlan(Plan):
    """One whole partition; ``group_by`` is recorded only."""

    group_by: str | None = None

    def build(self, meta) -> list[Partition]:
        whole = tuple((0, n) for n in meta.shape)
        return [Partition("session-000000", whole, whole, whole)]

    def to_dict(self) -> dict:
        return {"type": "session", "group_by": self.group_by}


def plan_from_dict(d: dict):
    kinds = {"time": TimeWindowPlan, "tile": SpatialTilePlan, "asset": AssetPlan, "session": SessionPlan}
    if d.get("type") not in kinds:
        raise PartitionValidationError(f"unknown partition plan {d.get('type')!r}")
    return kinds[d["type"]](**{k: v for k, v in d.items() if k != "type"})


def check_descriptors(parts: list[Partition], shape: tuple[int, ...]) -> None:
    """Positive shape, unique keys, coordinate types, rank, bounds, and read + trim = output."""
    if not shape or any(n <= 0 for n in shape):
        raise PartitionValidationError("the selected shape must be positive")
    if not parts:
        raise PartitionValidationError("a plan has one partition at least")
    keys = [p.key for p in parts]
    if len(set(keys)) != len(keys) or not all(isinstance(k, str) and k for k in keys):
        raise PartitionValidationError("partition keys must be unique, non-empty strings")
    for p in parts:
        if any(not isinstance(v, (int, str)) or isinstance(v, bool) for _, v in p.coordinates):
            raise PartitionValidationError(f"{p.key}: coordinates are integers or strings")
        if not len(p.read) == len(p.output) == len(p.trim) == len(shape):
            raise PartitionValidationError(f"{p.key}: rank differs from the selection's")
        for (a, b), (c, d), (e, f), n in zip(p.read, p.output, p.trim, shape):
            if not (0 <= a < b <= n and 0 <= c < d <= n):
                raise PartitionValidationError(f"{p.key}: a range is out of bounds")
            if (a + e, a + f) != (c, d) or not 0 <= e < f <= b - a:
                raise PartitionValidationError(f"{p.key}: read and trim don't make the output")


def check_cover(parts: list[Partition], shape: tuple[int, ...], axes: list[int] | None = None) -> None:
    """The outputs tile the array exactly."""
    axes = list(range(len(shape))) if axes is None else axes
    if not axes:
        if len(parts) != 1:
            raise PartitionValidationError("a scalar output has exactly one owner")
        return
    # Every border of any output cuts its axis; each cell of that grid must have one owner.
    cuts = [sorted({0, shape[i], *(x for p in parts for x in p.output[i])}) for i in axes]
    if math.prod(len(c) - 1 for c in cuts) > 64 * len(parts) * len(axes) + 4096:
        return _check_sorted(parts, shape, axes)
    owners = np.zeros([len(c) - 1 for c in cuts], np.int32)
    for p in parts:
        owners[tuple(slice(bisect_left(c, p.output[i][0]), bisect_left(c, p.output[i][1])) for c, i in zip(cuts, axes))] += 1
    if (owners == 0).any():
        raise PartitionValidationError("the outputs leave gaps")
    if (owners > 1).any():
        raise PartitionValidationError("two outputs overlap")


def _check_sorted(parts: list[Partition], shape: tuple[int, ...], axes: list[int]) -> None:
    """The same where there are very many borders: between two neighbouring borders of the first axis, the
    outputs that lie there must cover the other axes."""
    first, rest = axes[0], axes[1:]
    cuts = sorted({0, shape[first], *(x for p in parts for x in p.output[first])})
    starts: dict[int, list[Partition]] = {}
    for p in parts:
        starts.setdefault(p.output[first][0], []).append(p)
    here: list[Partition] = []
    for low in cuts[:-1]:
        here = [p for p in here if p.output[first][1] > low] + starts.get(low, [])
        if not here:
            raise PartitionValidationError("the outputs leave gaps")
        check_cover(here, shape, rest)


def check_reduced(parts: list[Partition], meta, reduced: tuple[str, ...]) -> None:
    for p in parts:
        for a, (lo, hi), n in zip(meta.axes, p.read, meta.shape):
            if a in reduced and (lo, hi) != (0, n):
                raise PartitionValidationError(f"the reduced axis {a!r} must be whole in every partition")


def check_chunks(parts: list[Partition], chunks: tuple[int, ...], axes: list[int]) -> None:
    """Each partition starts at a chunk border, so that no two write one chunk."""
    for p in parts:
        if any(p.output[i][0] % c for i, c in zip(axes, chunks)):
            raise PartitionValidationError(f"{p.key} doesn't start at an output chunk")


def check_halo(plan, required: dict[str, int | str]) -> None:
    have = {"time": getattr(plan, "overlap", 0)} | dict(getattr(plan, "halo", {}))
    for a, need in required.items():
        got = have.get(a, 0)
        if (isinstance(need, int) and not (isinstance(got, int) and got >= need)) or (isinstance(need, str) and got != need):
            raise PartitionValidationError(f"the function needs an overlap of {need} along {a!r}")


def touched_chunks(read: tuple[Range, ...], bounds, chunks: tuple[int, ...]) -> int:
    return math.prod((lo + b - 1) // c - (lo + a) // c + 1 for (a, b), (lo, _), c in zip(read, bounds, chunks))


def automatic_tiles(meta, retained: tuple[str, ...], output_chunks: dict[str, int] | None = None) -> SpatialTilePlan:
    """Retained axes by native chunk (a common multiple with the output's chunk); reduced ones whole."""
    tile = {}
    for i, a in enumerate(meta.axes):
        if a in retained:
            c = meta.chunks[i] if meta.chunks else meta.shape[i]
            tile[a] = min(meta.shape[i], math.lcm(c, (output_chunks or {}).get(a, c)))
    return SpatialTilePlan(tile)


def as_table(spark: SparkSession, parts: list[Partition], axes: tuple[str, ...]) -> DataFrame:
    """The plan as a DataFrame: key and, by axis, read and output ranges."""
    rows = [(i, p.key, *itertools.chain(*((*r, *o) for r, o in zip(p.read, p.output)))) for i, p in enumerate(parts)]
    names = ", ".join(f"`{a}_read_start` long, `{a}_read_stop` long, `{a}_start` long, `{a}_stop` long" for a in axes)
    return spark.createDataFrame(rows, f"tile long, key string, {names}")


def deal(cells: DataFrame, parts: list[Partition], axes: tuple[str, ...]) -> DataFrame:
    """Cells by partition (``tile``, ``key``), halos included, with ``owned``.

    Regular windows are found by arithmetic on each axis: a cell's home window and the neighbours
    whose read range may hold it are exploded and filtered; no range join, one narrow pass."""
    from pyspark.sql import functions as F

    out = cells
    owned = F.lit(True)
    number = F.lit(0).cast("bigint")
    for i, a in enumerate(axes):
        windows = sorted({(p.read[i], p.output[i]) for p in parts}, key=lambda w: w[1])
        starts = [w[1][0] for w in windows]
        size = starts[1] - starts[0] if len(starts) > 1 else windows[0][1][1] - windows[0][1][0]
        if any(s != k * size for k, s in enumerate(starts)):
            raise PartitionValidationError("only regular windows can be dealt")
        reach = max(max(o[0] - r[0], r[1] - o[1]) for r, o in windows)
        c = F.col(f"`{a}`")
        if len(windows) == 1:
            continue
        low, high = F.greatest(F.lit(0), F.floor((c - reach) / size)), F.least(F.lit(len(windows) - 1), F.floor((c + reach) / size))
        out = out.withColumn(f"_w_{a}", F.explode(F.sequence(low.cast("bigint"), high.cast("bigint"))))
        owned = owned & (F.floor(c / size) == F.col(f"_w_{a}"))
        number = number * len(windows) + F.col(f"_w_{a}")
    counts = [max(1, len({p.output[i] for p in parts})) for i in range(len(axes))]
    assert math.prod(counts) == len(parts)
    helpers = [f"_w_{a}" for i, a in enumerate(axes) if counts[i] > 1]
    return out.withColumn("tile", number).withColumn("owned", owned).drop(*helpers)
