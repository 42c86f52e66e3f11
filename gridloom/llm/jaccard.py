"""Word-shingle Jaccard join by token-combination prefixes.

A document is the set of its distinct ``k``-word shingles, here called tokens (64-bit hashes).
Equal sets are collapsed to one representative each. Tokens are ordered by frequency class and
hash: rare ones first. Frequent tokens (found by a mergeable Misra-Gries summary over all
documents) are further dealt to cells by hash. A document of n tokens that may lack e of them
(e = n - ceil(threshold * n)) is indexed by a prefix of this order, extended until

    (rare tokens) + sum over cells of max(0, frequent tokens in the cell - 1) >= e + 1,

each rare token as a signature, each pair of frequent tokens of one cell as another. Whichever e
tokens are lost, a rare token or a pair within a cell survives, and of two linked documents the
one whose prefix ends first has its survivor in the other's prefix too: linked documents share
a signature. (Where a set has too few tokens for that sum, its frequent tokens are signatures too.) Sets so
small that one token more is below the threshold link with equal sets only and aren't indexed. The number of cells follows the size band (power of two) of n; a document near a
band's end is indexed for the next band as well.

Per signature, the document that has the fewest rare tokens leads; (leader, member) pairs are
verified: parity sketches of the sets rule out nearly all false ones, the token sets decide the rest. Documents that aren't in their leader's component are compared, by sketches
and in blocks, with the leader's members in other components; what passes is verified again, so that no
link between components is lost while copies of one text are never expanded into all pairs.

Defined cases: null, empty and word-less texts have an empty set and link with nothing; fewer than
``k`` words are one shingle; repeated rows are equal sets; rows that share a doc_id are one node;
rows without a doc_id take part (those of one text are one node), but name no component; doc_ids
are under 2**62; an empty table gives an empty result; other columns are ignored by ``join_components`` and kept by ``keep_one``."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import Known, checkpoint, components, table
from gridloom.llm.textkit import LOWER_BYTE, chunks, mix, powers, windows, Q


#: Rows without an id get one at or over this, from their text.
NAMELESS = 1 << 62


def with_ids(documents: DataFrame) -> DataFrame:
    own = F.xxhash64("text").bitwiseAND(F.lit(NAMELESS - 1)).bitwiseOR(F.lit(NAMELESS))
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), own).alias("doc_id"), "text")


def named(column: str):
    """An id, or null for rows that had none."""
    return F.when(F.col(column) < NAMELESS, F.col(column))


def token_sets(words, k: int):
    """The sorted distinct tokens of each text of a chunk."""
    h = words.hashes(LOWER_BYTE)
    grams = windows(h, k)
    for t in range(len(words.first) - 1):
        a, b = int(words.first[t]), int(words.first[t + 1])
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            short = mix(np.array([(h[a:b] * powers(Q, b - a)).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
            yield short
        else:
            yield np.zeros(0, np.uint64)


def frequent_tokens(documents: DataFrame, k: int, floor: int, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens counted in ``floor`` documents or more by the Misra-Gries summary of ``entries``
    counters; each task keeps such a summary and summaries are added up. The result, at most
    ``entries`` rows, orders the tokens: it steers cost, never results."""

    def run(batches):
        token, count, waiting, waits = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def merge():
            nonlocal token, count, waiting, waits
            value, inverse = np.unique(np.concatenate([token, *waiting]), return_inverse=True)
            count = np.bincount(inverse, np.concatenate([count, np.ones(waits, np.int64)]), len(value)).astype(np.int64)
            token, waiting, waits = value, [], 0
            if len(token) > 4 * entries:
                count = count - np.partition(count, len(count) - entries - 1)[len(count) - entries - 1]
                token, count = token[count > 0], count[count > 0]

        for batch in batches:
            for _, words, _ in chunks(batch, "text"):
                for s in token_sets(words, k):
                    waiting.append(s)
                    waits += len(s)
                    if waits >= 4 * entries:
                        merge()
        merge()
        if len(token) > entries:
            less = np.partition(count, len(count) - entries - 1)[len(count) - entries - 1]
            keep = count > less
            token, count = token[keep], count[keep]
        several = count > 1
        yield pa.RecordBatch.from_arrays([pa.array(token[several].view(np.int64)), pa.array(count[several])], ["t", "n"])

    counts = documents.select("text").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).where(F.col("n") >= floor)
    rows = counts.orderBy(F.desc("n"), "t").limit(entries).toArrow()
    return np.sort(rows.column("t").to_numpy().view(np.uint64)), rows


def lacks(n: int, threshold: float) -> int:
    return n - math.ceil(threshold * n - 1e-9)


def equal_only(n, threshold: float):
    """Whether sets of n tokens (a number or a column) link with equal sets only: one token more is too many."""
    return 100 * n < round(threshold * 100) * (n + 1)


def prefix_signatures(rare: np.ndarray, frequent: np.ndarray, threshold: float) -> np.ndarray:
    """Signatures of one set (both parts sorted): see the module's text."""
    n = len(rare) + len(frequent)
    need = lacks(n, threshold) + 1
    band = n.bit_length() - 1
    bands = {band, int(n / threshold + 1e-9).bit_length() - 1, math.ceil(threshold * n - 1e-9).bit_length() - 1}
    head = rare[:need]
    out = [head]
    if need > len(rare):
        more = need - len(rare)
        for b in sorted(bands):
            cells = max(1, (1 << b) // 16)
            cell = (mix(frequent) % np.uint64(cells)).astype(np.int64)
            # How many tokens of its cell come before each token; all but a cell's first count.
            order = np.argsort(cell, kind="stable")
            starts = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=cells))])
            before = np.empty(len(cell), np.int64)
            before[order] = np.arange(len(cell)) - starts[cell[order]]
            gained = np.cumsum(before > 0)
            if gained[-1] < more:  # one token may be all that is shared
                out.append(frequent)
            stop = int(np.searchsorted(gained, more)) + 1
            if stop > len(cell):
                stop = len(cell)
            inside = order[order < stop]
            c = cell[inside]
            token = mix(frequent[inside] + np.uint64(b + 1))
            size = np.bincount(c, minlength=cells)
            for gap in range(1, int(size.max(initial=0))):
                same = c[gap:] == c[:-gap]
                out.append(mix(token[:-gap][same] * np.uint64(0x9E3779B97F4A7C15) + token[gap:][same]))
    return np.concatenate(out)


def sketch_of(tokens: np.ndarray) -> bytes:
    """Parities of the tokens by hash, in a power of two of bits, twice the tokens at least. Two sets
    differ in as many tokens as (folded to one length) their sketches do in bits, or more."""
    bits = max(64, 1 << (2 * len(tokens) - 1).bit_length())
    return np.packbits((np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def sketches_allow(x: bytes, y: bytes, n: int, m: int, threshold: float) -> bool:
    """False only if sets of n and m tokens with these sketches can't reach the threshold."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum()) <= (1 - threshold) / (1 + threshold) * (n + m) + 1e-6


def profiles(documents: DataFrame, k: int, threshold: float, frequent: np.ndarray) -> DataFrame:
    """One row per document: n tokens, 128-bit fingerprint of the set, signatures, sketch, priority."""

    def run(batches):
        for batch in batches:
            for part, words, _ in chunks(batch, "text"):
                n, one, two, signatures, sketch, priority = [], [], [], [], [], []
                for s in token_sets(words, k):
                    n.append(len(s))
                    one.append(int(mix(s).sum(dtype=np.uint64)) if len(s) else 0)
                    two.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) if len(s) else 0)
                    sketch.append(sketch_of(s))
                    if not len(s) or equal_only(len(s), threshold):
                        signatures.append(b"")
                        priority.append(len(s))
                        continue
                    if len(frequent):
                        at = np.searchsorted(frequent, s)
                        common = frequent[np.minimum(at, len(frequent) - 1)] == s
                    else:
                        common = np.zeros(len(s), bool)
                    rare = s[~common]
                    signatures.append(prefix_signatures(rare, s[common], threshold).tobytes())
                    # Fewest rare tokens first, then fewest tokens.
                    priority.append((len(rare) << 32) + len(s))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(n, pa.int64()),
                        pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64)),
                        pa.array(signatures, pa.binary()), pa.array(sketch, pa.binary()), pa.array(priority, pa.int64()),
                    ],
                    ["doc_id", "n", "f", "g", "signatures", "sketch", "priority"],
                )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, f long, g long, signatures binary, sketch binary, priority long")


def unpacked(index: DataFrame, known: Known | None) -> DataFrame:
    """(s, rep, priority): a row per signature, of those in ``known`` where there is one."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                values = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("signatures")]
                size = [len(v) for v in values]
                s = np.concatenate(values) if values else np.zeros(0, np.uint64)
                keep = np.ones(len(s), bool) if known is None else known.holds(s)
                owner = np.repeat(np.arange(part.num_rows), size)[keep]
                columns = [part.column(c).to_numpy(zero_copy_only=False)[owner] for c in ("rep", "priority")]
                yield pa.RecordBatch.from_arrays([pa.array(s[keep].view(np.int64)), *map(pa.array, columns)], ["s", "rep", "priority"])

    rows = index.select("rep", "priority", "signatures").mapInArrow(run, "s long, rep long, priority long")
    return rows if known is None else known.sift(rows, "s")


def sets_of(documents: DataFrame, k: int, wanted: Known) -> DataFrame:
    """(doc_id, tokens) of the documents whose id may be wanted."""

    def run(batches):
        for batch in batches:
            ids = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            batch = batch.filter(pa.array(wanted.holds(ids)))
            for part, words, _ in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in token_sets(words, k)], pa.binary())], ["doc_id", "tokens"])

    ids = documents.select("doc_id", F.xxhash64("doc_id").alias("h"), "text")
    return wanted.sift(ids, "h").mapInArrow(run, "doc_id long, tokens binary")


def verified(pairs: DataFrame, index: DataFrame, documents: DataFrame, k: int, threshold: float, repeats: bool, most: int) -> DataFrame:
    """The pairs (a, b) whose sets have at least ``threshold`` of their union in common.

    Sketches rule out nearly all others before any set is fetched; the sets of the rest are computed
    again from the texts of those documents (once an id and set, where ids repeat)."""
    num = round(threshold * 100)

    def likely(batches):
        for batch in batches:
            keep = [sketches_allow(x.as_py(), y.as_py(), n & 0xFFFFFFFF, m & 0xFFFFFFFF, threshold) for x, y, n, m in zip(batch.column("x"), batch.column("y"), batch.column("n").to_pylist(), batch.column("m").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                shared = int((y[at] == x).sum())
                keep.append(100 * shared >= num * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    short = index.select("rep", "sketch", "priority")
    sketched = pairs.join(short.select(F.col("rep").alias("a"), F.col("sketch").alias("x"), F.col("priority").alias("n")), "a").join(short.select(F.col("rep").alias("b"), F.col("sketch").alias("y"), F.col("priority").alias("m")), "b")
    likely_pairs = checkpoint(sketched.select("a", "b", "x", "y", "n", "m").mapInArrow(likely, "a long, b long").distinct())
    wanted = Known(likely_pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).select(F.xxhash64("doc_id").alias("h")).distinct(), "h", most)
    sets = sets_of(documents, k, wanted)
    sets = checkpoint(sets.distinct() if repeats else sets)
    both = likely_pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long").distinct()


def fold(sketches: np.ndarray, width: int) -> np.ndarray:
    """Rows of sketches (uint8) at half their width, as often as needed."""
    while sketches.shape[1] > width:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def cross_pairs(members: DataFrame, group: DataFrame, index: DataFrame, threshold: float, block: int = 256) -> DataFrame:
    """Pairs (a, b) that meet under one leader, stand in different components, and that sketches allow.

    Whatever shares a bucket shares its leader. Members outside their leader's component are queries
    against all its members, in tasks of ``block`` of each; only pairs that pass leave a task. A
    leader whose members are all in its component makes no work."""
    named = members.join(group.select(F.col("node").alias("rep"), F.col("component").alias("c")), "rep", "left")
    named = named.join(group.select(F.col("node").alias("lead"), F.col("component").alias("lead_c")), "lead", "left")
    named = checkpoint(named.select("lead", "rep", F.coalesce("c", "rep").alias("c"), (F.coalesce("c", "rep") != F.coalesce("lead_c", "lead")).alias("odd")))
    loads = named.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("odd").cast("long")).alias("q")).where("q > 0 AND n > 1")
    loads = loads.select("lead", F.ceil(F.col("q") / block).cast("int").alias("qs"), F.ceil(F.col("n") / block).cast("int").alias("ds"))
    rows = named.join(loads, "lead").join(index.select("rep", "sketch", "priority"), "rep")
    rows = rows.withColumn("i", F.pmod(F.xxhash64("rep"), "qs").cast("int")).withColumn("j", F.pmod(F.xxhash64("rep"), "ds").cast("int"))

    def role(i, j, query: bool):
        return F.struct(i.alias("i"), j.alias("j"), F.lit(query).alias("query"))

    as_data = F.transform(F.sequence(F.lit(0), F.col("qs") - 1), lambda i: role(i, F.col("j"), False))
    as_query = F.transform(F.sequence(F.lit(0), F.col("ds") - 1), lambda j: role(F.col("i"), j, True))
    tasks = rows.select("lead", "rep", "c", "sketch", "priority", F.explode(F.concat(as_data, F.when(F.col("odd"), as_query).otherwise(F.array().cast(ROLES)))).alias("r")).select("lead", "rep", "c", "sketch", "priority", "r.*")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    slack = (1 - threshold) / (1 + threshold)

    def run(table: pa.Table) -> pa.Table:
        query = table.column("query").to_numpy(zero_copy_only=False)
        rep, c = table.column("rep").to_numpy(), table.column("c").to_numpy()
        n = (table.column("priority").to_numpy() & 0xFFFFFFFF).astype(np.float64)
        raw = table.column("sketch").to_pylist()
        width = np.array([len(x) for x in raw])
        found = []
        for w in np.unique(width[query]):
            qs = np.flatnonzero(query & (width == w))
            ours = np.frombuffer(b"".join(raw[i] for i in qs), np.uint8).reshape(len(qs), w)
            for v in (w // 2, w, 2 * w):
                ds = np.flatnonzero(~query & (width == v))
                if not len(ds):
                    continue
                theirs = np.frombuffer(b"".join(raw[i] for i in ds), np.uint8).reshape(len(ds), v)
                u = min(v, w)
                x, y = np.ascontiguousarray(fold(ours, u)).view(np.uint64), np.ascontiguousarray(fold(theirs, u)).view(np.uint64)
                for k, row in zip(qs, x):
                    apart = np.bitwise_count(y ^ row).sum(axis=1)
                    good = (apart <= slack * (n[ds] + n[k]) + 1e-6) & (c[ds] != c[k]) & (np.minimum(n[ds], n[k]) >= (threshold - 1e-9) * np.maximum(n[ds], n[k]))
                    found += [(min(int(rep[k]), int(r)), max(int(rep[k]), int(r))) for r in rep[ds[good]]]
        pairs = np.array(sorted(set(found)), np.int64).reshape(-1, 2)
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=out)

    return tasks.groupBy("lead", "i", "j").applyInArrow(run, "a long, b long").distinct()


ROLES = "array<struct<i:int,j:int,query:boolean>>"


def indexed(documents: DataFrame, k: int, threshold: float, floor: int, entries: int, most: int):
    """Of documents with ids: (doc_id, n, rep) of all (rep null: no set), the representatives' profiles,
    (s, rep, priority) of their signatures, links between representatives of rows that share an id, and whether ids repeat."""
    frequent, _ = frequent_tokens(documents, k, floor, entries)
    # The tag names a row of the checkpoint; a class of equal sets is indexed by its first row's profile.
    made = checkpoint(profiles(documents, k, threshold, frequent).withColumn("tag", F.monotonically_increasing_id()))
    classes = checkpoint(made.where("n > 0").groupBy("n", "f", "g").agg(F.min("doc_id").alias("rep"), F.min("tag").alias("tag")))
    first = classes.where(~equal_only(F.col("n"), threshold)).select("tag", "rep")
    index = checkpoint(made.select("tag", "priority", "signatures", "sketch").join(first, "tag").select("rep", "priority", "signatures", "sketch"))
    members = checkpoint(made.select("doc_id", "n", "f", "g").join(classes.drop("tag"), ["n", "f", "g"], "left").select("doc_id", "n", "rep"))
    ids = checkpoint(members.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"), F.min("rep").alias("low"), F.max("rep").alias("high")).where("times > 1"))
    same = members.join(ids.where("low <> high").select("doc_id"), "doc_id", "left_semi").where("rep IS NOT NULL").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    # Most signatures are one document's alone: only their counts are shuffled, a bitmap takes them out,
    # and what it lets through by chance goes with the exact counts below.
    shared = unpacked(index, None).groupBy("s").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    return members, index, checkpoint(unpacked(index, Known(shared, "s", most))), same, not ids.isEmpty()


def join_pairs(documents: DataFrame, k: int, threshold: float, floor: int = 12, entries: int = 1 << 17, most: int = 27) -> tuple[DataFrame, DataFrame]:
    """The whole join: (a, b), every linked pair of representatives with a < b, and (doc_id, rep), the
    membership of all documents with a set. Documents of one representative link by equal sets. Rows without an id
    have those of ``with_ids``.

    Unlike components, the pairs of a group grow with its square."""
    documents = with_ids(documents)
    members, index, rows, _, repeats = indexed(documents, k, threshold, floor, entries, most)
    size = F.col("priority").bitwiseAND(F.lit(0xFFFFFFFF))
    one, two = rows.select("s", F.col("rep").alias("a"), size.alias("n")), rows.select("s", F.col("rep").alias("b"), size.alias("m"))
    fits = F.least("n", "m") >= F.lit(threshold - 1e-9) * F.greatest("n", "m")
    pairs = checkpoint(one.join(two, "s").where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct())
    return verified(pairs, index, documents, k, threshold, repeats, most), members.where("rep IS NOT NULL").select("doc_id", "rep")


def join_components(documents: DataFrame, k: int, threshold: float, floor: int = 12, entries: int = 1 << 17, most: int = 27) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    documents = with_ids(documents)
    all_, index, rows, same, repeats = indexed(documents, k, threshold, floor, entries, most)
    leaders = rows.groupBy("s").agg(F.min_by("rep", "priority").alias("lead"), F.min("priority").alias("lead_priority"), F.count(F.lit(1)).alias("m")).where("m > 1").withColumnRenamed("s", "s2")
    size = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    buckets = rows.join(leaders, F.col("s") == F.col("s2")).where("rep <> lead")
    members = checkpoint(buckets.select("lead", "rep", size("priority").alias("n"), size("lead_priority").alias("lead_n")).distinct())
    fits = F.least("n", "lead_n") >= F.lit(threshold - 1e-9) * F.greatest("n", "lead_n")
    first = checkpoint(members.where(fits).select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct())
    links = checkpoint(verified(first, index, documents, k, threshold, repeats, most).union(same))
    second = checkpoint(cross_pairs(members.select("lead", "rep"), components(links), index, threshold).join(first, ["a", "b"], "left_anti"))
    more = verified(second, index, documents, k, threshold, repeats, most)
    group = components(links.unionByName(more))
    out = all_.join(group.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return out.select(named("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id")).withColumn("component_id", named("component_id"))


def keep_one(documents: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents (all columns) without near duplicates: of each component that with the
    smallest id stays; of repeated rows of that id, one. Rows without an id stay."""
    names = documents.columns
    group = join_components(documents, k, threshold)
    lead = group.where("doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct()
    packed = documents.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"))
    kept = packed.join(lead, F.col("doc_id") == F.col("_id"), "left_semi").dropDuplicates(["doc_id"]).select("doc")
    rest = packed.where("doc_id IS NULL").select("doc")
    return kept.union(rest).select(*[F.col("doc")[c].alias(c) for c in names])


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"), 4, 0.85)
