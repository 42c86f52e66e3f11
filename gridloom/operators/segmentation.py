"""Tiled segmentation: labels with ids that are unique across tiles, and their objects."""

from __future__ import annotations

import importlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import expr, kernels
from gridloom.exceptions import AdapterCompatibilityError, UnsupportedBackendError
from gridloom.plans.partitions import SpatialTilePlan

BITS = 32


class SegmentationAdapter(kernels.Adapter):
    """``function(block, **parameters)`` giving (labels, objects); objects have a ``label_id`` column, and
    ``centroid_<i>``, ``bbox_min_<i>``, ``bbox_max_<i>`` in block coordinates where they have any."""

    def __init__(self, function, *, name: str = "labels", parameters: dict | None = None, requirements: kernels.Requirements | None = None):
        self.function, self.parameters = function, dict(parameters or {})
        self.name = f"segmentation.{getattr(function, '__qualname__', 'function')}"
        self.output = kernels.OutputSchema("segmentation", name, "uint64")
        self.requirements = requirements or kernels.Requirements(output_kinds=("segmentation",))

    def run(self, part: kernels.Loaded):
        return self.function(part.data, **self.parameters)


def objects_of(labels: np.ndarray) -> pd.DataFrame:
    """voxel_count, centroids and boxes (upper ends exclusive) of every label of a block."""
    where = np.nonzero(labels)
    ids, inverse = np.unique(labels[where], return_inverse=True)
    out = {"label_id": ids.astype(np.int64), "voxel_count": np.bincount(inverse, minlength=len(ids))}
    for i, c in enumerate(where):
        low, high = np.full(len(ids), np.iinfo(np.int64).max), np.full(len(ids), -1)
        np.minimum.at(low, inverse, c)
        np.maximum.at(high, inverse, c)
        out[f"centroid_{i}"] = np.bincount(inverse, c, len(ids)) / np.maximum(1, out["voxel_count"])
        out[f"bbox_min_{i}"], out[f"bbox_max_{i}"] = low, high + 1
    return pd.DataFrame(out)


def label_objects(cells: DataFrame, axes: tuple[str, ...], tile: str = "tile") -> DataFrame:
    """The same, natively, of label cells (axes..., value = local label, tile), with global ids."""
    sums = [F.count(F.lit(1)).alias("voxel_count")]
    for i, a in enumerate(axes):
        sums += [F.avg(a).alias(f"centroid_{i}"), F.min(a).alias(f"bbox_min_{i}"), (F.max(a) + 1).alias(f"bbox_max_{i}")]
    grouped = cells.where("value <> 0").groupBy(tile, F.col("value").cast("bigint").alias("local_label_id")).agg(*sums)
    return grouped.withColumn("label_id", F.shiftleft(F.col(tile).cast("bigint") + 1, BITS) + F.col("local_label_id"))


def global_labels(got, p, tile: int, axes: tuple[str, ...]) -> tuple[np.ndarray, pd.DataFrame]:
    """Owned labels as (tile + 1) << 32 | local, and the objects that they use, in array coordinates."""
    labels, objects = got
    labels = np.asarray(labels)
    if labels.dtype.kind not in "iu" or (labels.dtype.kind == "i" and (labels < 0).any()):
        raise AdapterCompatibilityError("labels must be whole numbers, not negative")
    if tile >= 2**31 - 2:
        raise AdapterCompatibilityError("too many tiles for 64-bit label ids")
    whole = tuple(b - a for a, b in p.read)
    if labels.shape == whole:
        labels = labels[tuple(slice(*t) for t in p.trim)]
    elif labels.shape != tuple(b - a for a, b in p.output):
        raise AdapterCompatibilityError("labels have neither the owned nor the read shape")
    used = np.unique(labels)
    used = used[used != 0].astype(np.uint64)
    if len(used) and int(used.max()) >= 1 << BITS:
        raise AdapterCompatibilityError("local label ids must be below 2**32")
    objects = objects.copy()
    known = set(objects["label_id"].astype("uint64"))
    if missing := [int(u) for u in used if u not in known]:
        raise AdapterCompatibilityError(f"labels {missing[:5]} have no object")
    objects = objects[objects["label_id"].isin(used)].reset_index(drop=True)
    base = np.uint64(tile + 1) << np.uint64(BITS)
    out = np.where(labels != 0, labels.astype(np.uint64) + base, np.uint64(0))
    local = objects["label_id"].astype("int64")
    objects["local_label_id"], objects["label_id"] = local, local + int(base)
    objects["tile_id"] = np.full(len(objects), tile, np.int64)
    objects["partition_id"] = pd.Series([p.key] * len(objects), dtype="string")
    for c in objects.columns:  # one type a column, whether or not the partition has objects
        if c == "voxel_count" or c.startswith("bbox_"):
            objects[c] = objects[c].astype("int64")
        elif c.startswith("centroid_"):
            objects[c] = objects[c].astype("float64")
    for i, (lo, _) in enumerate(p.read):
        for c in (f"centroid_{i}", f"bbox_min_{i}", f"bbox_max_{i}"):
            if c in objects:
                objects[c] = objects[c] + lo
    return out, objects


def segment(array, adapter, *, tile=None, halo=None, allow_unmerged: bool = False, output=None, **how):
    """Segmentation of a bare selection; splitting x or y leaves objects unmerged and must be allowed."""
    from gridloom.run import run

    if not isinstance(array.expression, expr.Input):
        raise TypeError("only a bare selection can be segmented")
    tile = dict(tile or {})
    if not allow_unmerged and any(a in tile and tile[a] < n for a, n in zip(array.axes, array.shape) if a in ("x", "y")):
        raise ValueError("tiles that split x or y aren't merged; pass allow_unmerged=True")
    return run(selection=array.selection, adapter=adapter, partition=SpatialTilePlan(tile, dict(halo or {})), output=output, spark=array.spark, **how)


def resolve_device(device: str = "auto") -> str:
    """auto, cpu or cuda; cuda is refused where there is none."""
    if device not in ("auto", "cpu", "cuda"):
        raise ValueError(f"unknown device {device!r}")
    try:
        torch = importlib.import_module("torch")
        there = bool(torch.cuda.is_available())
    except ImportError:
        there = False
    if device == "cuda" and not there:
        raise UnsupportedBackendError("no CUDA device here")
    return "cuda" if device == "cuda" or (device == "auto" and there) else "cpu"


_models: dict = {}


class CellposeAdapter(SegmentationAdapter):
    """The segmentation model of the optional package ``cellpose``, one model a worker process."""

    RESERVE = {"cpu": 2 << 30, "cuda": 1 << 30}

    def __init__(self, *, model: str = "cpsam", device: str = "auto", **parameters):
        super().__init__(self._evaluate, name="labels", parameters=parameters)
        self.name, self.model, self.device = "segmentation.cellpose", model, device
        self.requirements = kernels.Requirements(output_kinds=("segmentation",), resources={"gpu": 1} if device == "cuda" else {})

    def identity(self) -> dict:
        return super().identity() | {"model": self.model}

    def memory(self, block_bytes: int) -> int:
        return 16 * block_bytes + (64 << 20) + self.RESERVE["cuda" if self.device == "cuda" else "cpu"]

    def _evaluate(self, block, **parameters):
        try:
            models = importlib.import_module("cellpose.models")
        except ImportError as e:
            raise UnsupportedBackendError("this adapter needs the package cellpose") from e
        key = (self.model, device := resolve_device(self.device))
        if key not in _models:
            _models[key] = models.CellposeModel(gpu=device == "cuda", pretrained_model=self.model)
        plane = np.squeeze(block)
        masks = np.asarray(_models[key].eval(plane.astype(np.float32), **parameters)[0]).astype(np.uint64).reshape(block.shape)
        return masks, objects_of(masks)


def cellpose(array, *, output, memory_limit="4 GiB", **parameters):
    """2-D selections in one tile, with a z axis one plane a tile."""
    spatial = [a for a in array.axes if a != "z"]
    if sorted(spatial) != ["x", "y"] and not (len(array.axes) == 2):
        raise ValueError("a plane (y, x) or a stack (z, y, x) is needed")
    return segment(array, CellposeAdapter(**parameters), tile={"z": 1} if "z" in array.axes else {}, output=output, memory_limit=memory_limit)
