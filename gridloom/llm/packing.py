"""Best-fit packing of tokenised documents by bin completion.

Documents become token sequences plus an end id; longer ones are cut into pieces of the
capacity, the remainder first. What is packed is the histogram of piece lengths (at most
``capacity`` numbers, whatever the corpus), on the driver: take the largest length left,
enumerate the undominated fillings of the rest of its bin, by any number of pieces, use the chosen
filling as often as the counts allow (in its turn, fewer times). Depth-first branch-and-bound over these choices starts from the best-fit
decreasing solution as incumbent, prunes by a bound on waste and ends after ``nodes`` fillings. The plan is then dealt back:
the n-th piece of a length takes the n-th place that the plan has for that length.

Defined cases: a null or empty text is the end id alone; repeated rows and equal ids are packed
as separate documents; an empty table gives no pieces; other columns are ignored."""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import checkpoint, numbered, table

# One white-space character with the run after it, white space before such a one, the rest: no
# token of the vocabulary's pattern crosses a cut between these.
CHUNK = re.compile(r"\s?\S+|\s+(?=\s\S)|\s+")
# White space to Python's \s but not to the tokenizer's.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
# The quick encoder's pattern can't go back over much more white space than this.
LONG_SPACE = re.compile(r"\s{1000}")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def odd_classes() -> str:
    """Code points (as a pattern of one of them, or empty) that the two libraries put in different classes of the
    vocabulary's pattern: letters, digits, white space. Their tables follow different versions of Unicode."""
    import tiktoken
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    points = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    odd: set[str] = set()
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        single = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        mine = bytes(single._core_bpe.encode_ordinary(points)).decode()
        theirs = Split(Regex(name + "+"), "removed", invert=True).pre_tokenize_str(points)
        odd |= set(mine) ^ {c for run, _ in theirs for c in run}
    return f"[{''.join(map(re.escape, sorted(odd)))}]" if odd else ""


def _quick_model(path: str):
    """(vocabulary without special tokens, byte of each of its characters) of a plain byte-level file, else None."""
    model = json.loads(open(path, encoding="utf-8").read())
    if model["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or model["normalizer"]:
        return None
    if any(model["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return None
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    special = {t["content"] for t in model["added_tokens"]}
    return model, {k: v for k, v in model["model"]["vocab"].items() if k not in special}, byte


@lru_cache(4)
def same_ranks(path: str) -> str | None:
    """Whether a library that is quicker provably gives the ids of the vocabulary's own model: None if not, else a
    pattern of the code points that texts for it mustn't hold (empty: none). Proved once, on the driver.

    The file must be a plain byte-level one whose ids follow its merges: then both join the pair of least id first,
    the leftmost of equal ones. They could differ only where the quick one joins a pair that is no merge but spells a token.
    Take the first such join in a word, of x and y to z: all joins within z's bytes up to there are
    merges, in the order that z alone would take them, so that the file's model would leave z alone at x, y.
    Hence the two agree on a word where the model encodes the spelling of every token as that token, which is tried here for
    all of them. Both cut texts into words by one pattern, so that only code points of different classes can part them."""
    from tokenizers import Tokenizer

    found = _quick_model(path)
    if not found:
        return None
    model, known, byte = found
    joined = [known["".join(m if isinstance(m, list) else m.split(" "))] for m in model["model"]["merges"]]
    if joined != sorted(set(joined)) or not all(c in byte for k in known for c in k) or not all(c in known for c in byte):
        return None
    alone = Tokenizer.from_str(json.dumps({**model, "added_tokens": [], "pre_tokenizer": None, "post_processor": None, "decoder": None}))
    tokens = list(known)
    if any(e.ids != [known[t]] for t, e in zip(tokens, alone.encode_batch_fast(tokens, add_special_tokens=False))):
        return None
    return odd_classes()


def quick_encoder(path: str):
    import tiktoken

    _, known, byte = _quick_model(path)
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks={bytes(byte[c] for c in k): v for k, v in known.items()}, special_tokens={})._core_bpe.encode_ordinary


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes. ``odd`` is what ``same_ranks`` says of the file: texts without such code
    points, special tokens and long white space go through the quick encoder as a whole. Of others, chunks that tokens can't
    cross are encoded once and kept in two generations of up to ``keep``: those not met again while the younger one fills go."""

    def __init__(self, path: str, odd: str | None = None, keep: int = 100_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keep, self.known, self.older = keep, {}, {}
        self.odd = re.compile(odd) if odd else None
        self.quick = None if odd is None else quick_encoder(path)

    def forget(self) -> None:
        self.known, self.older = {}, {}

    def direct(self, text: str) -> bytes:
        return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        parts = {}
        for i, t in enumerate(texts):
            if any(s in t for s in self.special):
                out[i] = self.direct(t)
            elif self.quick and not LONG_SPACE.search(t) and (not self.odd or t.isascii() or not self.odd.search(t)):
                out[i] = _bytes(self.quick(t))
            elif any(c in t for c in ODD):
                out[i] = self.direct(t)
            else:
                parts[i] = CHUNK.findall(t)
        if not parts:
            return out
        if len(self.known) > self.keep:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = set().union(*parts.values()).difference(known)
        met = older.keys() & new
        known.update((c, older[c]) for c in met)
        new = [*(new - met)]
        for c, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False) if new else ()):
            known[c] = _bytes(e.ids)
        for i, p in parts.items():
            out[i] = b"".join(map(known.__getitem__, p))
        return out


@lru_cache(2)
def encoder(path: str, odd: str | None = None) -> Encoder:
    """One for each worker process; tasks leave its chunks empty, as other stages use the same process."""
    return Encoder(path, odd)


def token_pieces(documents: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, checksum of its ids."""
    end = np.array([end_id], "<u4").tobytes()
    odd = same_ranks(path)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        known = encoder(path, odd)
        encode = known.encode
        known.forget()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            i = 0
            while i < len(ids):
                group, size = [], 0
                while i + len(group) < len(ids) and (not group or size < 1 << 20) and len(group) < 512:
                    t = texts[i + len(group)].as_py() or ""
                    group.append(t)
                    size += len(t)
                out = [[], [], [], [], []]
                for doc, data in zip(ids[i : i + len(group)], encode(group)):
                    data += end
                    n = len(data) // 4
                    k = -(-n // capacity)
                    at = 0
                    for p in range(k):
                        to = n - (k - 1 - p) * capacity
                        for column, x in zip(out, (doc, p, at, to - at, zlib.crc32(data[4 * at : 4 * to]))):
                            column.append(x)
                        at = to
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                i += len(group)
        known.forget()

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Martello and Toth's L2 bound on the number of bins, from a histogram of lengths."""
    sizes = np.arange(len(counts))
    number, total = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * sizes)])
    half = capacity // 2 + 1
    k = np.arange(0, capacity // 2 + 1)
    top = capacity - k + 1
    n1 = number[-1] - number[np.minimum(top, len(counts))]
    mid = np.maximum(np.minimum(top, len(counts)), half)
    n2, s2 = number[mid] - number[half], total[mid] - total[half]
    s3 = total[half] - total[k]
    return int(max(0, np.max(n1 + n2 + np.maximum(0, -(-(s3 - (n2 * capacity - s2)) // capacity))), -(-int(total[-1]) // capacity)))


class _Left:
    """Lengths left, with the largest one at most x and the sums that lengths up to x can make."""

    def __init__(self, counts: np.ndarray):
        self.n = [int(c) for c in counts]
        self.sizes = [x for x, c in enumerate(self.n) if c]
        self.sums, self.good = [1] * len(self.n), 0  # sums[x] holds for x <= good

    def take(self, size: int, times: int) -> None:
        self.n[size] -= times
        self.good = min(self.good, size - 1)
        if not self.n[size]:
            del self.sizes[bisect_right(self.sizes, size) - 1]

    def give(self, size: int, times: int) -> None:
        if not self.n[size]:
            self.sizes.insert(bisect_right(self.sizes, size), size)
        self.n[size] += times
        self.good = min(self.good, size - 1)

    def under(self, x: int) -> int:
        i = bisect_right(self.sizes, x)
        return self.sizes[i - 1] if i else 0

    def reach(self, x: int) -> int:
        """The sums (bits) of lengths up to x, each used as often as it is left at most."""
        for size in range(self.good + 1, x + 1):
            self.sums[size] = more_sums(self.sums[size - 1], size, self.n[size], len(self.n))
        self.good = max(self.good, x)
        return self.sums[x]


def more_sums(sums: int, size: int, times: int, bits: int) -> int:
    """Sums (bits) after up to ``times`` pieces of one length, added by doubling."""
    times, step = min(times, bits // size) if times else 0, 1
    while times:
        step = min(step, times)
        sums |= sums << step * size
        times -= step
        step *= 2
    return sums & ((1 << bits) - 1)


def fillings(left: _Left, room: int, big: int, slack=lambda: 1 << 62):
    """Every filling of ``room``, by any number of lengths, beside one piece of the largest length
    left, ``big``, that nothing more fits into: least waste first (while ``slack()`` allows it), and of
    equal waste the larger lengths first.

    Tables of sums tell what can be made, so that no step looks in vain. ``left`` must be as it was
    whenever the next filling is asked for."""

    def made(x: int, total: int, reach, least: int):
        """Lengths over ``least`` and up to x that make this total."""
        if not total:
            yield ()
            return
        x = left.under(min(x, total))
        while x > least and reach(x) >> total & 1:
            below = left.under(x - 1)
            for times in range(min(left.n[x] - (x == big), total // x), 0, -1):
                if reach(max(below, least)) >> (total - times * x) & 1:
                    for f in made(below, total - times * x, reach, least):
                        yield (x,) * times + f
            x = below

    for waste in range(room + 1):
        if waste > slack():
            return
        # Pieces no larger than the waste must all be in: the filling could take more otherwise.
        at = bisect_right(left.sizes, waste)
        small = [x for x in reversed(left.sizes[:at]) for _ in range(left.n[x] - (x == big))]
        total = room - waste - sum(small)
        if total < 0:
            continue
        if small:
            known, sums = {waste: 1}, 1
            for x in left.sizes[at : bisect_right(left.sizes, room)]:
                known[x] = sums = more_sums(sums, x, left.n[x] - (x == big), room + 1)
            if sums >> total & 1:
                for f in made(room, total, known.__getitem__, waste):
                    yield (*f, *small)
        elif left.reach(min(big, room)) >> total & 1:
            yield from made(min(big, room), total, left.reach, 0)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: (lengths of a bin, number of such bins)."""
    left, plan = _Left(counts), []
    while left.sizes:
        bin_, room, x = [], capacity, capacity
        while x := left.under(min(x, room)):
            if left.n[x] > bin_.count(x):
                bin_.append(x)
                room -= x
            else:
                x -= 1
        times = min(int(left.n[x]) // bin_.count(x) for x in bin_)
        for x in set(bin_):
            left.take(x, times * bin_.count(x))
        plan.append((tuple(bin_), times))
    return plan


def pack(counts: np.ndarray, capacity: int = 2048, nodes: int = 20_000) -> list[tuple[tuple[int, ...], int]]:
    """Bin completion with branch-and-bound over a histogram of lengths (index = length), by limited
    discrepancy: first choices only, then plans that leave them once, twice, and so on. The search is
    whole but for its limit of ``nodes`` fillings looked at."""
    total = int((counts * np.arange(len(counts))).sum())
    left = _Left(counts)
    capacity = left.reach(capacity).bit_length() - 1  # no bin holds more than the largest sum of lengths
    if not capacity:
        return []
    bound = lower_bound(counts, capacity)
    incumbent = best_fit(counts, capacity)
    bins = sum(t for _, t in incumbent)
    if bins == bound:
        return incumbent
    path: list[tuple[tuple[int, ...], int]] = []
    used = wasted = spent = 0

    def slack() -> int:
        return (bins - 1) * capacity - total - wasted

    def options():
        """Each bin with the largest length left, as often as the counts allow; then each fewer times."""
        big = left.sizes[-1]
        for fewer in (False, True):
            for f in fillings(left, capacity - big, big, slack):
                bin_ = (big, *f)
                most = min(left.n[x] // bin_.count(x) for x in set(bin_))
                for times in range(most - 1, 0, -1) if fewer else (most,):
                    yield bin_, times

    def dominated(bin_) -> bool:
        """Whether a larger piece fits in the place of one of the filling."""
        waste = capacity - sum(bin_)
        swaps = ((x, left.under(min(x + waste, bin_[0]))) for x in set(bin_[1:]))
        return waste > 0 and any(y > x and left.n[y] > bin_.count(y) for x, y in swaps)

    def move(bin_, times) -> None:
        nonlocal used, wasted
        for x in set(bin_):
            (left.take if times > 0 else left.give)(x, abs(times) * bin_.count(x))
        used, wasted = used + times, wasted + times * (capacity - sum(bin_))

    allowed, cut = -1, True
    while cut and bins > bound and spent < nodes:
        allowed, cut = allowed + 1, False
        todo = [(options(), allowed)]
        while todo and spent < nodes:
            choices, spare = todo[-1]
            step = next(choices, None)
            while step and dominated(step[0]) and spent < nodes:
                spent += 1
                step = next(choices, None)
            cut = cut or (step is not None and spare < 0)
            if step is None or spare < 0:
                todo.pop()
                if path:
                    bin_, times = path.pop()
                    move(bin_, -times)
                continue
            spent += 1
            todo[-1] = choices, spare - 1
            move(*step)
            path.append(step)
            if left.sizes and slack() >= 0:
                todo.append((options(), spare))
                continue
            if slack() >= 0:
                bins, incumbent = used, path.copy()
                if bins == bound:
                    return incumbent
            path.pop()
            move(step[0], -step[1])  # complete, or so much waste that no better plan is left
        for bin_, times in reversed(path):
            move(bin_, -times)
        path.clear()
    return incumbent


def pack_pieces(pieces: DataFrame, capacity: int = 2048, nodes: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns doc_id, piece, length)."""
    pieces = checkpoint(pieces)
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[size] = n
    places: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for bin_, times in pack(counts, capacity, nodes):
        offset = 0
        for x in bin_:
            places.setdefault(x, []).append((times, base, offset))
            offset += x
        base += times
    keys, bases, offsets = [], [], []
    for x in sorted(places):
        n = 0
        for times, first, offset in places[x]:
            keys.append((x << 44) + n)
            bases.append(first - n)
            offsets.append(offset)
            n += times
    keys_, bases_, offsets_ = (np.array(a, np.int64) for a in (keys, bases, offsets))

    def place(batches):
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            at = np.searchsorted(keys_, (length << 44) + rank, "right") - 1
            b = b.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bases_[at] + rank), pa.array(offsets_[at])], [*b.schema.names, "sequence_id", "offset"])

    ranked = numbered(pieces, ["length"], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "rank")
    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def pack_documents(documents: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    return pack_pieces(token_pieces(documents, path or vocabulary(), capacity, end_id), capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
