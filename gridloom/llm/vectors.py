"""Near-duplicate vectors by collision counting over sorted one-dimensional projections.

Vectors of one label (and length) are put on the unit sphere; equal ones are collapsed. A pair at
the threshold differs by a vector of known length, so that its difference along a Gaussian
direction is normal with known deviation. Each of ``projections`` directions is sorted, and a
window of ``width`` deviations around each query collides with a pair at the threshold with a known
probability p; the count that such a pair reaches except with probability ``miss`` (a binomial
tail) is the calibrated count. Pairs that pass it are verified by their cosine.

Work is cut along one more direction into tiles as wide as a window of ``tile_width`` deviations:
a query meets its own tile and the next. Tiles of more than ``block_bytes`` of vectors are cut into blocks,
and pairs of blocks are tasks of bounded memory; a task emits sums of links by vector and a spanning
forest of its links, never the pairs.

Defined cases: a null label, or a vector that is null, empty, zero or holds null or non-finite
components links with nothing; vectors of different length are never compared; a null vec_id
links with nothing and is kept; repeated rows are vectors of their own; rows that share a vec_id are one node
of the components; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import checkpoint, components, table


def deviation(threshold: float, dim: int) -> float:
    """Of a threshold pair's difference along a direction with variance 1 / dim."""
    return math.sqrt(2 - 2 * threshold) / math.sqrt(dim)


def calibrated(projections: int, width: float, miss: float) -> int:
    """The largest count that a threshold pair fails to reach with probability ``miss`` at most."""
    p = math.erf(width / math.sqrt(2))
    below = 0.0
    for c in range(projections + 1):
        below += math.comb(projections, c) * p**c * (1 - p) ** (projections - c)
        if below > miss:
            return c
    return projections


def directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).standard_normal((n, dim)) / math.sqrt(dim)


def collisions(query: np.ndarray, data: np.ndarray, half: float, order: np.ndarray | None = None) -> np.ndarray:
    """Counts (queries x data) of projections in which a data value lies in the query's window.

    ``query`` and ``data``: projections x vectors; ``order``: the data's ranks by projection, where known."""
    count = np.zeros((query.shape[1], data.shape[1]), np.uint8)
    for q, d, rank in zip(query, data, np.argsort(data, axis=1, kind="stable") if order is None else order):
        values = d[rank]
        low, high = np.searchsorted(values, q - half, "left"), np.searchsorted(values, q + half, "right")
        for row, a, b in zip(count, low.tolist(), high.tolist()):
            row[rank[a:b]] += 1
    return count


def _unit(classes: DataFrame, threshold: float, tile_width: float, seed: int) -> DataFrame:
    """Unit vectors (label, dim, rep, mult, tile, unit) of sound ones."""
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())

    def run(batches):
        for batch in batches:
            e = batch.column("embedding")
            size, values = np.diff(e.offsets.to_numpy()), e.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            begin = np.cumsum(size) - size
            for dim in np.unique(size):
                rows = np.flatnonzero(size == dim)
                v = values[begin[rows][:, None] + np.arange(dim)]
                v = v / np.abs(v).max(axis=1, keepdims=True)  # no square overflows
                v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
                at = v @ directions(int(dim), 1, seed)[0]
                tile = np.floor(at / (tile_width * deviation(threshold, int(dim)))).astype(np.int32)
                own = [batch.column(c).to_numpy(zero_copy_only=False)[rows] for c in ("label", "rep", "mult")]
                columns = (own[0], np.full(len(rows), dim), own[1], own[2], tile, [x.tobytes() for x in v])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["label", "dim", "rep", "mult", "tile", "unit"])

    return classes.select("label", "rep", "mult", "embedding").mapInArrow(run, "label long, dim int, rep long, mult long, tile int, unit binary")


def _forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    parent = list(range(n))
    kept = []
    for a, b in pairs.tolist():
        x, y = a, b
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def links(vectors: DataFrame, threshold: float, projections: int = 40, width: float = 1.5, miss: float = 1e-6, tile_width: float = 5.0, block_bytes: int = 1 << 23, queries: int = 512, seed: int = 11) -> DataFrame:
    """Of vectors (label, rep, mult, embedding): rows (a, b, w): b null and w the number of
    vectors that a is linked with in one task, or a link (a, b) of a spanning forest."""
    rows = checkpoint(_unit(vectors, threshold, tile_width, seed))
    counts = rows.groupBy("label", "dim", "tile").agg(F.ceil(F.count(F.lit(1)) * F.col("dim") * 8 / F.lit(block_bytes)).cast("int").alias("blocks"))
    around = {
        name: counts.select(F.col("label").alias(f"{name}_l"), F.col("dim").alias(f"{name}_d"), (F.col("tile") + shift).alias(f"{name}_t"), F.col("blocks").alias(name))
        for name, shift in (("own", 0), ("next", -1), ("prior", 1))
    }
    dealt = rows
    for name, c in around.items():
        dealt = dealt.join(c, (F.col("label") == F.col(f"{name}_l")) & (F.col("dim") == F.col(f"{name}_d")) & (F.col("tile") == F.col(f"{name}_t")), "left").drop(f"{name}_l", f"{name}_d", f"{name}_t")
    dealt = dealt.withColumn("blk", F.pmod(F.xxhash64("rep"), "own").cast("int"))
    span = lambda low, high: F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<int>"))
    zero = F.lit(0)

    def role(tile, queries, data, kind: str, is_query: bool):
        return F.struct(tile.cast("int").alias("tile"), queries.alias("i"), data.alias("j"), F.lit(kind).alias("kind"), F.lit(is_query).alias("q"))

    blk, tile = F.col("blk"), F.col("tile")
    roles = F.concat(
        F.transform(span(blk, F.col("own")), lambda j: role(tile, blk, j, "own", True)),
        F.transform(span(zero, blk), lambda i: role(tile, i, blk, "own", False)),
        F.transform(span(zero, F.coalesce(F.col("next"), zero)), lambda j: role(tile, blk, j, "next", True)),
        F.transform(span(zero, F.coalesce(F.col("prior"), zero)), lambda i: role(tile - 1, i, blk, "next", False)),
    )
    tasks = dealt.select("label", "dim", "rep", "mult", "unit", F.explode(roles).alias("r")).select("label", "dim", "rep", "mult", "unit", "r.*")
    out_schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("w", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        q = group.column("q").to_numpy()
        dim = group.column("dim")[0].as_py()
        within = group.column("kind")[0].as_py() == "own" and group.column("i")[0].as_py() == group.column("j")[0].as_py()
        rep, mult = group.column("rep").to_numpy(), group.column("mult").to_numpy()
        unit = np.frombuffer(b"".join(group.column("unit").to_pylist()), np.float64).reshape(len(q), dim)
        if (not within and q.all()) or not q.any() or len(q) < 2:
            return out_schema.empty_table()
        qi = np.flatnonzero(q)
        di = qi if within else np.flatnonzero(~q)
        at = directions(dim, projections, seed + 1) @ unit.T
        least, half, order = max(1, calibrated(projections, width, miss)), width * deviation(threshold, dim), np.argsort(at[:, di], axis=1, kind="stable")
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k in range(0, len(qi), queries):
            part = qi[k : k + queries]
            i, j = np.nonzero(collisions(at[:, part], at[:, di], half, order) >= least)
            if within:
                i, j = i[j > i + k], j[j > i + k]
            i, j = part[i], di[j]
            for m in range(0, len(i), 1 << 15):
                a, b = i[m : m + (1 << 15)], j[m : m + (1 << 15)]
                good = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
                found.append((a[good], b[good]))
        x, y = (np.concatenate(c) for c in zip(*found))
        sums = np.bincount(x, mult[y], len(q)) + np.bincount(y, mult[x], len(q))
        linked = np.flatnonzero(sums)
        forest = np.array(_forest(len(q), np.column_stack([x, y])), np.int64).reshape(-1, 2)
        a = np.concatenate([rep[linked], rep[forest[:, 0]]])
        b = pa.array(np.concatenate([np.zeros(len(linked), np.int64), rep[forest[:, 1]]]), mask=np.arange(len(a)) < len(linked))
        w = np.concatenate([sums[linked].astype(np.int64), np.zeros(len(forest), np.int64)])
        return pa.Table.from_arrays([pa.array(a), b, pa.array(w)], schema=out_schema)

    return tasks.groupBy("label", "dim", "tile", "i", "j", "kind").applyInArrow(run, "a long, b long, w long")


def near_vectors(vectors: DataFrame, threshold: float = 0.93, **how) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    # Only sound vectors are hashed: a hash of an array passes over its nulls.
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size("embedding") > 0) & finite, F.lit(False))
    rows = rows.withColumn("h", F.when(sound, F.xxhash64("embedding"))).withColumn("g", F.when(sound, F.xxhash64(F.lit(1), "embedding")))
    classes = checkpoint(rows.where("h IS NOT NULL").groupBy("label", "h", "g").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("embedding").alias("embedding")))
    found = checkpoint(links(classes, threshold, **how))
    sums = found.where("b IS NULL").groupBy("a").agg(F.sum("w").alias("w"))
    group = components(found.where("b IS NOT NULL").select("a", "b"))
    of_class = (
        classes.select(F.col("label").alias("l2"), F.col("h").alias("h2"), F.col("g").alias("g2"), "rep", "mult")
        .join(sums, F.col("rep") == F.col("a"), "left")
        .join(group, F.col("rep") == F.col("node"), "left")
        .select("l2", "h2", "g2", (F.coalesce("w", F.lit(0)) + F.col("mult") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("c"))
    )
    out = rows.join(of_class, (F.col("label") == F.col("l2")) & (F.col("h") == F.col("h2")) & (F.col("g") == F.col("g2")), "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op5_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
