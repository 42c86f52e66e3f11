"""Sharding by a hierarchical weighted hash tree.

A topology is a list of regions, each a list of racks, each a list of shards (number and
weight). A key descends region, rack and shard: at each level every child draws
``-ln(u) / weight`` with ``u`` from a hash of the key and the child's path, and the least draw
wins. A subtree's draw depends on its own weight alone, so that a change of weights moves keys
only into subtrees whose weight rose or out of those whose weight fell.

``add_shard`` opens a new region for the new shard. It is then the only region whose weight
changes, and rows move into the new shard and nowhere else, whatever the shape of the tree.

Defined cases: a null key is a key like others; equal keys share a shard; a null text counts 0
bytes and has a null checksum; an empty table gives an empty result; other columns, whatever
their names, are ignored by ``assign_table`` and kept by ``assign``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import numbered, table

Topology = list[list[list[tuple[int, float]]]]


def topology(shards: int, racks: int = 3, per_rack: int = 4, weights: list[float] | None = None) -> Topology:
    """Shards 0 .. shards-1 in order, ``per_rack`` to a rack and ``racks`` to a region."""
    w = weights or [1.0] * shards
    leaves = [(s, float(w[s])) for s in range(shards)]
    rows = [leaves[i : i + per_rack] for i in range(0, shards, per_rack)]
    return [rows[i : i + racks] for i in range(0, len(rows), racks)]


def add_shard(tree: Topology, weight: float = 1.0) -> Topology:
    new = 1 + max(s for region in tree for rack in region for s, _ in rack)
    return [*tree, [[(new, weight)]]]


def _weight(node) -> float:
    return node[1] if isinstance(node, tuple) else sum(map(_weight, node))


def _draw(key: list[Column], level: int, parent: Column, weights: list[list[float]]) -> Column:
    """Index of the child that wins among the children of ``parent`` (an index into ``weights``).

    A child's hash takes the level, the parent's and its own index; a zero weight draws nothing."""
    most = max(map(len, weights))
    flat = F.array(*[F.lit(float(w)) for row in weights for w in [*row, *[0.0] * (most - len(row))]])
    draws = []
    for i in range(most):
        u = (F.shiftrightunsigned(F.xxhash64(*key, F.lit(level), parent, F.lit(i)), 11).cast("double") + F.lit(0.5)) / F.lit(float(2**53))
        weight = F.element_at(flat, parent * most + i + 1)
        draws.append(F.when(weight > 0, F.struct((-F.ln(u) / weight).alias("d"), F.lit(i).alias("i"))))
    return F.array_min(F.array(*draws))["i"]


def assign(df: DataFrame, key: list[str], tree: Topology, out: str = "shard") -> DataFrame:
    """Adds each row's shard by native expressions, one projection a level; no shuffle."""
    columns = [F.col(f"`{k}`") for k in key]
    racks = [rack for region in tree for rack in region]
    before = [sum(len(r) for r in tree[:i]) for i in range(len(tree))]
    shards = F.array(*[F.lit(s) for rack in racks for s, _ in rack])
    first = [sum(len(r) for r in racks[:i]) for i in range(len(racks))]
    at = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), i + 1)
    names = [f"_tree_{level}_{out}" for level in range(3)]
    down = df.withColumn(names[0], _draw(columns, 0, F.lit(0), [[_weight(r) for r in tree]]))
    pick = _draw(columns, 1, F.col(names[0]), [[_weight(k) for k in r] for r in tree])
    down = down.withColumn(names[1], at(before, F.col(names[0])) + pick)
    pick = _draw(columns, 2, F.col(names[1]), [[w for _, w in rack] for rack in racks])
    down = down.withColumn(names[2], at(first, F.col(names[1])) + pick)
    return down.withColumn(out, F.element_at(shards, F.col(names[2]) + 1).cast("int")).drop(*names)


def grown(shards: int, founded: int = 24) -> Topology:
    """The tree of ``founded`` shards after it grew to ``shards``, one by one: what ``shards`` and one more
    shard give agrees with ``add_shard`` for every number."""
    if shards < founded:
        raise ValueError(f"the tree was founded with {founded} shards and only grows")
    tree = topology(founded)
    for _ in range(shards - founded):
        tree = add_shard(tree)
    return tree


def assign_table(documents: DataFrame, shards: int = 24, founded: int = 24) -> DataFrame:
    """Every document with shard, gapless slot within it, and its shard after adding one.

    Only ids, sizes and checksums are shuffled, by (shard, hash bucket)."""
    tree = grown(shards, founded)
    bytes_ = F.encode("text", "UTF-8")
    rows = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(bytes_).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = assign(assign(rows, ["doc_id"], tree), ["doc_id"], add_shard(tree), "grown_shard")
    done = numbered(rows, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], [F.col("doc_id"), F.col("text_crc32")], "slot")
    return done.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op1_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_table(table(spark, sf_dir, "documents"), 24)
