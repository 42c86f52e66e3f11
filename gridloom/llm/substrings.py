"""Substring deduplication: word windows that recur anywhere are cut out of the documents.

1. Anchors. Each window of ``window`` words has a minimiser, the leftmost place of its ``anchor``-word
   sequence of the least hash; equal windows have it at equal places. Minimisers that occur twice or more in
   the corpus are known to the tasks.
2. Confirmation. Consecutive windows with one minimiser place are a run. Runs with a recurring minimiser are
   counted by their words (64-bit hash, and the minimiser's). A run that occurs elsewhere as a whole settles
   its windows; where some run of a minimiser doesn't, windows of that minimiser are counted one by one. What occurs
   twice or more is a passage. Documents are dealt to shards by hash, and of all occurrences
   of a passage in a shard one place alone, in the document of the least key, leaves this step.
3. Automata. A shard's passages are cut out of these documents and compiled to an Aho-Corasick automaton over
   word numbers; all documents of the shard are streamed through it, and its matches are the places of
   every passage. All words of an occurrence lie in recurring windows, so they go. (Passages that have one
   occurrence in a shard are united where they overlap.)

A shard holds about ``shard_bytes`` of text; of a shard that is larger, because one text is or because many rows agree in
id and text, parts are streamed one after another, with the passages found so far.

Defined cases: a null or empty text has no words; repeated rows are separate documents, so all
their windows recur; an empty table gives an empty result; other columns are ignored by
``op8_repeated_passages`` and kept by ``remove``."""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import Known, stored, table
from gridloom.llm.textkit import Words, chunks, stretches, windows


def _sliding(x: np.ndarray, k: int, f) -> np.ndarray:
    """f over each k consecutive entries (f: np.minimum or np.maximum), in log k steps."""
    have, out = 1, x
    while 2 * have <= k:
        out = f(out[: len(out) - have], out[have:])
        have *= 2
    return f(out[: len(out) - (k - have)], out[k - have :]) if k > have else out


PLACE = np.uint64((1 << 30) - 1)


def _minimisers(words: Words, window: int, anchor: int):
    """(word hashes, place of each window's minimiser, its hash, whether a window starts there). Entries are
    by word number, over all texts of the chunk."""
    h = words.hashes()
    n = len(h)
    if n < window:
        return h, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    grams = windows(h, anchor)
    # 34 bits of the hash order the places; equal ones go by place, the same way in equal windows.
    code = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    at = (_sliding(code, window - anchor + 1, np.minimum) & PLACE).astype(np.int64)
    stop = np.repeat(words.first[1:], np.diff(words.first))
    whole = np.arange(n - window + 1) + window <= stop[: n - window + 1]
    return h, at, grams[at], whole


class _Runs:
    """Runs of consecutive windows of a chunk that have one minimiser place, where its hash ``v`` is known:
    first word ``begin``, word behind the last ``stop`` (under 2 * window words)."""

    def __init__(self, words: Words, window: int, anchor: int, anchors: Known | None):
        self.words, self.v = words, np.zeros(0, np.uint64)
        self.begin = self.stop = np.zeros(0, np.int64)
        self.hashes, at, value, whole = _minimisers(words, window, anchor)
        if not whole.any():
            return
        edge, last = np.ones(len(at), bool), np.ones(len(at), bool)
        edge[1:] = (at[1:] != at[:-1]) | ~whole[:-1]
        last[:-1] = edge[1:] | ~whole[1:]
        begin, end = np.flatnonzero(whole & edge), np.flatnonzero(whole & last)
        if anchors is not None:
            keep = anchors.holds(value[begin])
            begin, end = begin[keep], end[keep]
        self.begin, self.stop, self.v = begin, end + window, value[begin]

    def hash(self) -> np.ndarray:
        return stretches(self.hashes, self.begin, self.stop)


def anchor_counts(documents: DataFrame, window: int, anchor: int) -> DataFrame:
    """Minimisers (as longs) that have two occurrences or more in the corpus."""

    def run(batches):
        for batch in batches:
            for _, words, _ in chunks(batch, "text"):
                value, times = np.unique(_Runs(words, window, anchor, None).v, return_counts=True)
                yield pa.RecordBatch.from_arrays([_long(value), pa.array(np.minimum(times, 2).astype(np.int32))], ["h", "n"])

    return documents.select("text").mapInArrow(run, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


#: A place: first word, number of words (20 bits).
SPAN = 20


def _rows(part, words: Words, at: np.ndarray, size, h: np.ndarray, v: np.ndarray, n: int | None = None):
    """Batches of counted rows (h, v, n, shard, key, place); with n they have no place."""
    for i in range(0, len(at), 1 << 16):
        s = slice(i, i + (1 << 16))
        text = np.searchsorted(words.first, at[s], "right") - 1
        none = None if n is None else np.ones(len(text), bool)
        shard, key = (part.column(c).to_numpy(zero_copy_only=False)[text] for c in ("shard", "key"))
        place = (at[s] - words.first[text] << SPAN) + (size[s] if isinstance(size, np.ndarray) else size)
        yield pa.RecordBatch.from_arrays(
            [_long(h[s]), _long(v[s]), pa.array(np.full(len(text), n or 1, np.int64)), pa.array(np.where(n is None, shard, -1).astype(np.int32)), pa.array(key, mask=none), pa.array(place.astype(np.int64), mask=none)],
            ["h", "v", "n", "shard", "key", "place"],
        )


COUNTED = "h long, v long, n long, shard int, key long, place long"


def _runs(documents: DataFrame, window: int, anchor: int, anchors: Known) -> DataFrame:
    """A row per run whose minimiser may recur."""

    def run(batches):
        for batch in batches:
            for part, words, _ in chunks(batch, "text"):
                r = _Runs(words, window, anchor, anchors)
                yield from _rows(part, words, r.begin, r.stop - r.begin, r.hash(), r.v)

    return anchors.sift(documents.select("shard", "key", "text").mapInArrow(run, COUNTED), "v").select(*[c.split()[0] for c in COUNTED.split(", ")])


def _windows(documents: DataFrame, window: int, anchor: int, open_: Known, single: Known) -> DataFrame:
    """Windows of minimisers in ``open_``. Those of runs in ``single`` (all runs that aren't settled) have a
    place; those of other runs, which are settled, only count: distinct in each chunk, with n = 2."""

    def run(batches):
        for batch in batches:
            for part, words, _ in chunks(batch, "text"):
                r = _Runs(words, window, anchor, open_)
                if not len(r.begin):
                    continue
                size = r.stop - r.begin - window + 1
                at = np.arange(size.sum()) + np.repeat(r.begin - (np.cumsum(size) - size), size)
                v, h, placed = np.repeat(r.v, size), windows(r.hashes, window)[at], np.repeat(single.holds(r.hash()), size)
                yield from _rows(part, words, at[placed], window, h[placed], v[placed])
                _, first = np.unique(h[~placed], return_index=True)
                yield from _rows(part, words, at[~placed][first], window, h[~placed][first], v[~placed][first], 2)

    return open_.sift(documents.select("shard", "key", "text").mapInArrow(run, COUNTED), "v").select(*[c.split()[0] for c in COUNTED.split(", ")])


def _counted(rows: DataFrame) -> DataFrame:
    """One row per (h, v) and shard: n there, the place of the least key, and ``total`` of all shards.

    Partial sums come before the shuffle, and a hot passage is at most one row a shard behind it."""
    own = rows.groupBy("h", "v", "shard").agg(F.sum("n").alias("n"), F.min("key").alias("key"), F.min_by("place", "key").alias("place"))
    return stored(own.withColumn("total", F.sum("n").over(W.partitionBy("h", "v"))))


def recurring(documents: DataFrame, window: int, anchor: int, most: int) -> DataFrame:
    """(shard, key, place, alone): one place of each recurring passage in each shard that has it; ``alone``
    where it is the only one there."""
    anchors = Known(anchor_counts(documents, window, anchor), "h", most)
    runs = _counted(_runs(documents, window, anchor, anchors))
    # A run that occurs elsewhere as a whole settles its windows. Where another run of the same minimiser
    # doesn't, the windows of all runs of that minimiser are compared one by one.
    open_ = runs.groupBy("v").agg(F.sum("n").alias("n"), F.bool_and(F.col("total") > 1).alias("settled")).where("n > 1 AND NOT settled").select("v")
    single = _counted(_windows(documents, window, anchor, Known(open_, "v", most), Known(runs.where("total = 1"), "h", most)))
    found = runs.unionByName(single).where("total > 1 AND key IS NOT NULL")
    return found.select("shard", "key", "place", (F.col("n") == 1).alias("alone"))


#: Code points that a word number may take: all but surrogates, and but 0, which ends a text.
LETTERS = 0x10F7FF


def _letters(numbers: np.ndarray, wide: bool) -> str:
    """Word numbers (0: the end of a text) as code points, two each where one isn't enough."""
    x = np.column_stack([numbers >> 20, numbers & 0xFFFFF]).ravel() if wide else numbers
    return np.where(x < 0xD800, x, x + 0x800).astype("<u4").tobytes().decode("utf-32-le")


def occurrences(texts: list[np.ndarray], passages: list[np.ndarray], most: int = LETTERS) -> list[np.ndarray]:
    """For each text (word hashes), whether each word lies in an occurrence of a passage (word hashes): the
    texts are streamed through one automaton of the distinct passages. ``most``: word numbers that one code point holds."""
    size = np.array([len(t) for t in texts], np.int64)
    if not passages or not size.sum():
        return [np.zeros(n, bool) for n in size]
    every, number = np.unique(np.concatenate([*texts, *passages]), return_inverse=True)
    number, wide = number + 1, len(every) > most
    width = 1 + wide
    begin = np.cumsum(size + 1) - size - 1
    stream = np.zeros(size.sum() + len(size), np.int64)
    stream[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = number[: size.sum()]
    automaton, at = ahocorasick.Automaton(), int(size.sum())
    coded = _letters(number[at:], wide)
    at = 0
    for p in passages:
        automaton.add_word(coded[at * width : (at + len(p)) * width], len(p))
        at += len(p)
    automaton.make_automaton()
    found = np.array(list(automaton.iter(_letters(stream, wide))), np.int64).reshape(-1, 2)
    if wide:  # a match begins and ends at whole words
        found = found[found[:, 0] % 2 == 1]
    end = (found[:, 0] + 1) // width
    step = np.bincount(end - found[:, 1], minlength=len(stream) + 1) - np.bincount(end, minlength=len(stream) + 1)
    gone = np.cumsum(step[:-1]) > 0
    return [gone[a : a + n] for a, n in zip(begin, size)]


def _united(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping spans as one."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], stop[order]
    reach = np.maximum.accumulate(stop)
    cut = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]])) if len(start) else np.zeros(0, np.int64)
    return list(zip(start[cut].tolist(), reach[np.append(cut[1:], len(start)) - 1].tolist() if len(cut) else []))


class _Shard:
    """Streams one shard: rows ordered by key, a document's places before it."""

    def __init__(self, limit: int):
        self.limit, self.shard, self.parts, self.bytes, self.passages = limit, None, [], 0, []

    def feed(self, shard: int, rows: pa.RecordBatch):
        if shard != self.shard:
            yield from self.finish()
            self.shard, self.passages = shard, []
        self.parts.append(rows)
        self.bytes += rows.nbytes
        if self.bytes > self.limit:
            table = pa.Table.from_batches(self.parts).combine_chunks().to_batches()[0]
            is_text = np.flatnonzero(table.column("is_text").to_numpy(zero_copy_only=False))
            if len(is_text):  # places at the end wait for their document
                stop = int(is_text[-1]) + 1
                self.parts = [table.slice(0, stop)]
                rest = table.slice(stop)
                yield from self.finish()
                self.parts, self.bytes = ([rest], rest.nbytes) if rest.num_rows else ([], 0)

    def finish(self):
        """(documents' rows, their words by chunk, what goes) of the rows so far."""
        parts, self.parts, self.bytes = self.parts, [], 0
        if not parts:
            return
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        is_text = rows.column("is_text").to_numpy(zero_copy_only=False).astype(bool)
        places, docs = rows.filter(pa.array(~is_text)), rows.filter(pa.array(is_text))
        cut = list(chunks(docs, "text"))
        hashes = [words.hashes() for _, words, _ in cut]
        texts = [h[words.first[t] : words.first[t + 1]] for h, (_, words, _) in zip(hashes, cut) for t in range(len(words.first) - 1)]
        keys = docs.column("key").to_numpy(zero_copy_only=False)
        key, place, alone = (places.column(c).to_numpy(zero_copy_only=False) for c in ("key", "place", "alone"))
        own, alone = np.searchsorted(keys, key), alone.astype(bool)
        start, size = place >> SPAN, place & ((1 << SPAN) - 1)
        kept = [texts[d][a : a + n] for d, a, n in zip(own[~alone], start[~alone], size[~alone])]
        single = []
        for d in np.unique(own[alone]):
            here = alone & (own == d) if len(own) < 64 else np.flatnonzero(alone)[np.searchsorted(own[alone], d) : np.searchsorted(own[alone], d, "right")]
            single += [texts[d][a:b] for a, b in _united(start[here], start[here] + size[here])]
        self.passages += kept
        gone = occurrences(texts, self.passages + single)
        at = 0
        for part, words, valid in cut:
            n = part.num_rows
            yield part, words, valid, gone[at : at + n]
            at += n


def scan(documents: DataFrame, passages: DataFrame, columns: list[str], finish, schema: str, fields: list[str], limit: int = 1 << 24) -> DataFrame:
    """Streams documents (shard, key, text, ``columns``) through the automata of their shards, parts of up to
    ``limit`` bytes at a time; ``finish(raw text, word starts, word ends, gone)`` makes the result's further columns."""

    def made(part, words, valid, gone):
        rows = []
        for t in range(part.num_rows):
            a, b = words.first[t], words.first[t + 1]
            lo, hi = words.offsets[t], words.offsets[t + 1]
            rows.append(finish(words.data[lo:hi] if valid[t] else None, words.start[a:b] - lo, words.end[a:b] - lo, gone[t]))
        new = pa.Table.from_pylist([dict(zip(fields, r)) for r in rows], schema=_arrow(fields)).combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], *new.columns], [*columns, *fields])

    def run(batches):
        stream = _Shard(limit)
        for batch in batches:
            shard = batch.column("shard").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    for done in stream.feed(int(shard[a]), batch.slice(a, b - a)):
                        yield made(*done)
        for done in stream.finish():
            yield made(*done)

    texts = documents.select("shard", "key", F.lit(True).alias("is_text"), F.lit(None).cast("long").alias("place"), F.lit(None).cast("boolean").alias("alone"), "text", *columns)
    kinds = dict(documents.dtypes)
    places = passages.select("shard", "key", F.lit(False).alias("is_text"), "place", "alone", F.lit(None).cast("string").alias("text"), *[F.lit(None).cast(documents.schema[c].dataType).alias(c) for c in columns if c in kinds])
    return texts.union(places).repartition("shard").sortWithinPartitions("shard", "key", "is_text").mapInArrow(run, schema)


def _arrow(fields: list[str]) -> pa.Schema:
    kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()}
    return pa.schema([(f, kinds[f]) for f in fields])


def keyed(documents: DataFrame, shard_bytes: int = 1 << 22) -> DataFrame:
    """Adds key, a hash of id and text (rows that agree in both have the same passages), and shard, another."""
    total = documents.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    shards = int(min(total // shard_bytes + 1, 1 << 30))
    return documents.withColumn("key", F.xxhash64("doc_id", "text")).withColumn("shard", F.pmod(F.xxhash64(F.lit(1), "doc_id", "text"), F.lit(shards)).cast("int"))


def _digest(data, start, end, gone):
    keep = np.flatnonzero(~gone)
    if data is None or not len(keep):
        return len(start), int(gone.sum()), hashlib.sha256(b"").hexdigest()
    raw = data.tobytes()
    words = [raw[a:b] for a, b in zip(start[keep].tolist(), end[keep].tolist())]
    return len(start), int(gone.sum()), hashlib.sha256(b" ".join(words)).hexdigest()


def _cut(data, start, end, gone):
    """The text without the words that go; what stays keeps its own white space."""
    if data is None:
        return (None,)
    if not gone.any():
        return (data.tobytes().decode(),)
    stay = np.ones(len(data), bool)
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1):
        stay[start[a] : start[b + 1] if b + 1 < len(start) else end[b]] = False
    return (data[stay].tobytes().decode().strip(" "),)


def remove(documents: DataFrame, window: int = 50, anchor: int = 8, most: int = 27, shard_bytes: int = 1 << 22) -> DataFrame:
    """The documents (all columns and rows) with recurring passages cut out of the text.
    ``n_chars``, where there is one, follows the new text. ``most``: see ``Known``."""
    names = documents.columns
    packed = documents.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("doc"))
    packed = keyed(packed, shard_bytes).drop("doc_id")
    kind = packed.schema["doc"].dataType.simpleString()
    out = scan(packed, recurring(packed, window, anchor, most), ["doc"], _cut, f"doc {kind}, kept string", ["kept"])

    def column(c):
        if c == "text":
            return F.col("kept").alias("text")
        if c == "n_chars":
            return F.char_length("kept").cast("long").alias(c)
        return F.col("doc")[c].alias(c)

    return out.select(*[column(c) for c in names])


def digests(documents: DataFrame, window: int, anchor: int = 8, most: int = 27, shard_bytes: int = 1 << 22, limit: int = 1 << 24) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    rows = keyed(documents.select(F.col("doc_id").cast("long"), "text"), shard_bytes)
    return scan(rows, recurring(rows, window, anchor, most), ["doc_id"], _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string", ["n_words", "n_removed", "kept_sha256"], limit)


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), 35)
