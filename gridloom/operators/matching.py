"""Comparison of two segmentations by an optimal one-to-one matching of their objects."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DecimalType, IntegerType, LongType, ShortType


@dataclass(frozen=True)
class SegmentationMetrics:
    precision: float
    recall: float
    f1: float
    mean_matched_iou: float
    foreground_dice: float
    matched: int
    predicted: int
    reference: int
    threshold: float = 0.5


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the one-to-one matching with the largest total gain (shortest
    augmenting paths with potentials)."""
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain).astype(np.float64)
    n, m = cost.shape
    if not n or not m:
        return []
    row_price, column_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for r in range(n):
        distance, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, base, column = r, 0.0, -1
        while True:
            reach = base + cost[row] - row_price[row] - column_price
            better = ~done & (reach < distance)
            distance[better], came[better] = reach[better], column
            column = int(np.argmin(np.where(done, np.inf, distance)))
            base, done[column] = distance[column], True
            if owner[column] < 0:
                break
            row = owner[column]
        settled = done & (np.arange(m) != column)
        for c in np.flatnonzero(settled):
            row_price[owner[c]] += base - distance[c]
        row_price[r] += base
        column_price[settled] -= base - distance[settled]
        while column >= 0:
            before = came[column]
            owner[column] = r if before < 0 else owner[before]
            column = before
    return [(int(c), int(r)) if flip else (int(r), int(c)) for c, r in enumerate(owner) if r >= 0]


def overlaps(predicted: DataFrame, reference: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """(p, r, n): how many cells have each pair of labels, background 0 included; null where one side has
    no cell. One join and one aggregation; all measures come from this table of labels, whatever the number of cells."""
    a = predicted.select(*axes, F.col("value").cast("long").alias("p"))
    b = reference.select(*axes, F.col("value").cast("long").alias("r"))
    return a.join(b, list(axes), "full").groupBy("p", "r").agg(F.count(F.lit(1)).alias("n"))


def iou_pairs(predicted: DataFrame, reference: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """Overlapping pairs (p, r, n, np, nr, iou) of two label volumes: counts by pair and by label."""
    return _ious(overlaps(predicted, reference, axes))


def _ious(counts: DataFrame) -> DataFrame:
    def sizes(label: str) -> DataFrame:
        return counts.where(F.col(label) != 0).groupBy(label).agg(F.sum("n").alias(f"n{label}"))

    pairs = counts.where("p <> 0 AND r <> 0").join(sizes("p"), "p").join(sizes("r"), "r")
    return pairs.withColumn("iou", F.col("n") / (F.col("np") + F.col("nr") - F.col("n")))


def _integers(volume: DataFrame) -> bool:
    kind = volume.schema["value"].dataType
    return isinstance(kind, (ByteType, ShortType, IntegerType, LongType)) or (isinstance(kind, DecimalType) and kind.scale == 0)


def compare_segmentations(predicted: DataFrame, reference: DataFrame, axes: tuple[str, ...], threshold: float = 0.5) -> SegmentationMetrics:
    """Matching first, threshold after: a pair over the threshold need not be matched.

    Labels are whole numbers, 0 is background, and both volumes have the same cells. A pair that shares cells with nothing
    else is matched where it is; only those of larger groups come to the driver, where each group is matched alone."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is over 0 and at most 1")
    if not (_integers(predicted) and _integers(reference)):
        raise TypeError("segmentations hold whole numbers")
    counts = overlaps(predicted, reference, axes).persist()
    try:
        total = counts.agg(
            F.count(F.when(F.col("p").isNull() | F.col("r").isNull(), 1)).alias("apart"), F.count(F.when((F.col("p") < 0) | (F.col("r") < 0), 1)).alias("negative"),
            F.count_distinct(F.when(F.col("p") != 0, F.col("p"))).alias("n_p"), F.count_distinct(F.when(F.col("r") != 0, F.col("r"))).alias("n_r"),
            F.sum(F.when(F.col("p") != 0, F.col("n")).otherwise(0)).alias("v_p"), F.sum(F.when(F.col("r") != 0, F.col("n")).otherwise(0)).alias("v_r"),
            F.sum(F.when((F.col("p") != 0) & (F.col("r") != 0), F.col("n")).otherwise(0)).alias("both"),
        ).first()
        if total.apart:
            raise ValueError("the two segmentations have different cells")
        if total.negative:
            raise ValueError("labels aren't negative")
        pairs = _ious(counts)
        several = [pairs.groupBy(k).agg(F.count(F.lit(1)).alias(f"{k}s")) for k in ("p", "r")]
        pairs = pairs.join(several[0], "p").join(several[1], "r")
        alone = pairs.where(f"ps = 1 AND rs = 1 AND iou >= {threshold!r}").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("iou"), F.lit(0.0)).alias("iou")).first()
        rows = pairs.where("ps > 1 OR rs > 1").select("p", "r", "iou").collect()
    finally:
        counts.unpersist()
    found = [x for x in _matched(rows) if x >= threshold]
    n_p, n_r, n = total.n_p, total.n_r, alone.n + len(found)
    precision = n / n_p if n_p else float(not n_r)
    recall = n / n_r if n_r else float(not n_p)
    f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
    voxels = (total.v_p or 0) + (total.v_r or 0)
    return SegmentationMetrics(precision, recall, f1, (alone.iou + float(np.sum(found))) / n if n else 0.0, 2 * total.both / voxels if voxels else 1.0, n, n_p, n_r, threshold)


def _matched(rows) -> list[float]:
    """IoUs of the best matching of each group of objects that share cells."""
    near: dict = {}
    for r in rows:
        near.setdefault(("p", r.p), []).append((("r", r.r), r.iou))
        near.setdefault(("r", r.r), []).append((("p", r.p), r.iou))
    seen: set = set()
    out: list[float] = []
    for start in near:
        if start in seen:
            continue
        group, todo = [], [start]
        seen.add(start)
        while todo:
            x = todo.pop()
            group.append(x)
            fresh = {y for y, _ in near[x]} - seen
            seen |= fresh
            todo += fresh
        ps, rs = sorted(x for x in group if x[0] == "p"), sorted(x for x in group if x[0] == "r")
        at = {x: i for i, x in enumerate(rs)}
        gain = np.zeros((len(ps), len(rs)))
        for i, x in enumerate(ps):
            for y, iou in near[x]:
                gain[i, at[y]] = iou
        out += [float(gain[i, j]) for i, j in assignment(gain) if gain[i, j] > 0]
    return out
