"""Temperature mixing of sources to target weights.

Source token shares p are raised to an exponent t and normalised: w ~ p**t (t = 1 keeps the
corpus, t = 0 makes sources equal). The exponent is bisected to the entropy asked for and then
raised where needed until no source must be repeated more often than the limit. Weights times
the budget are the sources' token budgets, realised by block permutations: a source's documents
are dealt by hash to blocks (of about ``block_tokens`` however many they are), blocks and the documents in them come
in hashed order, whole epochs first; the last, partial epoch ends in one block, with the document that reaches the
budget. That block is found by its range of the order, one of 4,096, first, so that no window spans a source. Rows that agree in id and text share a hash and are used alike.

Defined cases: null sources are one source of their own; a null or empty text has no tokens and
comes with the epochs of its block; repeated rows are separate documents; an empty table gives
an empty result; other columns stay (one named ``mix_epoch`` is replaced)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.llm.common import checkpoint, table

WORD = r"[^\x20\x09-\x0D]+"


def tempered(tokens: list[float], exponent: float) -> list[float]:
    top = max(tokens)
    raised = [(x / top) ** exponent if x > 0 else 0.0 for x in tokens]
    total = math.fsum(raised)
    return [x / total for x in raised]


def entropy(weights: list[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def _bisect(good, low: float, high: float, steps: int = 60) -> float:
    """The least value in low..high at which ``good`` holds, which is monotone and holds at high."""
    if good(low):
        return low
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if good(mid) else (mid, high)
    return high


def covering(tokens: list[float], weights: list[float]) -> float:
    """The least budget that gives every source one whole epoch."""
    return max(x / w for x, w in zip(tokens, weights) if w > 0)


def solve(tokens: list[float], budget: float | None, share_of_entropy: float, repeats: float) -> tuple[float, list[float]]:
    """Exponent and weights. Entropy aimed at: ``share_of_entropy`` of the way from the corpus's
    own to that of equal sources. ``repeats``: the most epochs of any source; a budget beyond
    that many epochs of the whole corpus keeps the corpus's own shares (exponent 1). Without a
    budget, the covering one of the weights holds."""
    own, most = entropy(tempered(tokens, 1.0)), math.log(max(1, sum(x > 0 for x in tokens)))
    target = own + share_of_entropy * (most - own)
    exponent = 1.0 - _bisect(lambda s: entropy(tempered(tokens, 1.0 - s)) >= target - 1e-12, 0.0, 1.0) if most > own else 1.0

    def fits(t: float) -> bool:
        weights = tempered(tokens, t)
        size = covering(tokens, weights) if budget is None else budget
        return all(w * size <= repeats * x * (1 + 1e-9) for w, x in zip(weights, tokens))

    if not fits(exponent):
        exponent = _bisect(fits, exponent, 1.0)
    return exponent, tempered(tokens, exponent)


def tokens() -> Column:
    """Words of the text, as a native measure of tokens."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def mix(documents: DataFrame, budget: float | None = None, share_of_entropy: float = 0.5, repeats: float = 2.0, seed: int = 17, block_tokens: int = 1 << 17, most_sources: int = 1_000_000, broadcast_sources: int = 10_000) -> DataFrame:
    """The documents of the mixture with ``mix_epoch`` (0, 1, ...; one row per use).

    ``budget`` is a multiple of the corpus's tokens; without one every source has a whole epoch and
    small ones have more, so that no document is lost. Totals by source go to the driver, one
    number each, at most ``most_sources`` of them (more are refused). The permutation is settled on
    (source, hash, tokens) alone: sums by (source, block) give the block in which a source's last epoch
    ends, that block's rows the hash up to which documents are in it. These few numbers a source decide
    each row, so that texts aren't shuffled (with over ``broadcast_sources`` sources: once)."""
    spark = documents.sparkSession
    # The documents travel as one struct, so that no column of theirs can clash with ours.
    rows = documents.select("source", F.xxhash64("doc_id", "text", F.lit(seed)).alias("_hash"), tokens().alias("_tokens"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_doc"))
    narrow = checkpoint(rows.groupBy("source", "_hash").agg(F.sum("_tokens").alias("_tokens")))
    totals = narrow.groupBy("source").agg(F.sum("_tokens").alias("t")).limit(most_sources + 1).collect()
    if len(totals) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    sizes = [float(r.t) for r in totals]
    if not totals or not sum(sizes):
        return documents.select(*[c for c in documents.columns if c != "mix_epoch"], F.lit(0).alias("mix_epoch"))
    all_ = sum(sizes)
    _, weights = solve(sizes, None if budget is None else budget * all_, share_of_entropy, repeats)
    size = covering(sizes, weights) * (1 + 1e-12) if budget is None else budget * all_
    few = F.broadcast if len(totals) <= broadcast_sources else lambda x: x
    plan = []
    for r, w in zip(totals, weights):
        epochs = w * size / r.t if r.t else 1.0
        full = int(epochs + 1e-9)
        part = (epochs - full) * r.t
        # Less than half a token is rounding, not a further epoch.
        plan.append((r.source, max(1, r.t // block_tokens), full, part if part >= 0.5 else 0.0))
    kind = documents.schema["source"].dataType.simpleString()
    plan = spark.createDataFrame(plan, f"_s {kind}, _blocks long, _full int, _part double")
    same = F.col("source").eqNullSafe(F.col("_s"))
    block = F.pmod("_hash", "_blocks")
    order = F.xxhash64(block, F.lit(seed + 1))
    dealt = narrow.join(few(plan), same).select("source", "_hash", "_tokens", "_part", order.alias("_order"), block.alias("_block"))
    blocks = dealt.groupBy("source", "_order", "_block").agg(F.sum("_tokens").alias("_n"), F.first("_part").alias("_part"))
    # The range of the order (its top 12 bits), then the block in which the budget ends.
    blocks = checkpoint(blocks.withColumn("_range", F.shiftright("_order", 52)))
    ranges = blocks.groupBy("source", "_range").agg(F.sum("_n").alias("_n"), F.first("_part").alias("_part"))
    ahead = lambda *order: F.coalesce(F.sum("_n").over(W.partitionBy("source").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ending = ranges.withColumn("_left", F.col("_part") - ahead("_range")).where("_left > 0").groupBy("source").agg(F.max("_range").alias("_r"), F.min("_left").alias("_left")).select(F.col("source").alias("_s"), "_r", "_left")
    last = (
        blocks.join(few(checkpoint(ending)), same & (F.col("_range") == F.col("_r"))).withColumn("_rest", F.col("_left") - ahead("_order", "_block")).where("_rest > 0")
        .groupBy("source").agg(F.max(F.struct("_order", "_block", "_rest", "_n")).alias("e"))
        .select(F.col("source").alias("_s"), F.col("e._order").alias("_eo"), F.col("e._block").alias("_eb"), F.col("e._rest").alias("_rest"), F.col("e._n").alias("_en"))
    )
    last = checkpoint(last)
    inside = dealt.join(few(last), same & (F.col("_block") == F.col("_eb")))
    running = F.coalesce(F.sum("_tokens").over(W.partitionBy("source").orderBy("_hash").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = inside.withColumn("_ahead", running).where(F.col("_ahead") < F.col("_rest")).groupBy("source").agg(F.max("_hash").alias("_cut")).select(F.col("source").alias("_s"), "_cut")
    ends = plan.alias("p").join(last.select(F.col("_s").alias("_s2"), "_eo", "_eb"), F.col("p._s").eqNullSafe(F.col("_s2")), "left").drop("_s2")
    ends = ends.join(cut.select(F.col("_s").alias("_s3"), "_cut"), F.col("p._s").eqNullSafe(F.col("_s3")), "left").select("_s", "_blocks", "_full", "_eo", "_eb", "_cut")
    ends = checkpoint(ends)
    joined = rows.join(few(ends), same).withColumn("_block", block).withColumn("_order", order)
    sooner = (F.col("_order") < F.col("_eo")) | ((F.col("_order") == F.col("_eo")) & (F.col("_block") < F.col("_eb")))
    here = (F.col("_block") == F.col("_eb")) & (F.col("_hash") <= F.col("_cut"))
    used = joined.withColumn("_uses", F.col("_full") + F.when(sooner | here, 1).otherwise(0)).where("_uses > 0")
    return used.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("_uses") - 1))).select(*[F.col("_doc")[c].alias(c) for c in documents.columns if c != "mix_epoch"], "mix_epoch")


def op10_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per use of a document: doc_id, source, its tokens and the epoch."""
    mixed = mix(table(spark, sf_dir, "documents"), budget=1.0)
    return mixed.select("doc_id", "source", tokens().alias("tokens"), "mix_epoch")
