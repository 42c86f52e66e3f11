"""Line-sequence quality rules: a linear-chain conditional random field over a text's lines.

Each line has bucketed features (length, symbols, capitals, separators, digits, word length, repeated
words, repetition of earlier lines, end punctuation, position). Viterbi decoding marks every line
as content or boilerplate; a text is kept if it passes the base rules and the content lines hold at
least ``share`` of its words.

Labels exist for documents, not for lines, so the field is fitted in rounds: first every line takes its document's
quality; then lines are decoded (``decodings`` times at most) and keep what they are decoded as, unless that turned
their document's label over, and the field is refitted. The sample is bounded: ``sample`` labelled ids, drawn by a
hash of the id, and twice as many texts, of at most ``text_bytes`` bytes each; an id with several labels has the least. All counts cover every row and whole texts.

Defined cases: a null or empty text has no words and fails the base rules; without labels of both kinds
all lines count as content; labels that are null, or of documents that aren't there, train nothing;
repeated rows are judged each; an empty table gives an empty result; other columns are ignored by
``judge`` and kept by ``keep_good``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import table
from gridloom.llm.crf import forward_backward, viterbi
from gridloom.llm.textkit import Words, chunks, mix, windows

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
LOWER = np.zeros(256, bool)
LOWER[0x61:0x7B] = True
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True
OTHER = np.zeros(256, bool)
OTHER[[c for c in range(0x21, 0x80) if not (UPPER[c] or LOWER[c] or DIGIT[c]) and c not in b".,;:'\"-()?"]] = True
BAR = np.zeros(256, bool)
BAR[ord("|")] = True
STOP = list(b".!?:;\"')")
CUTS = np.array([0.001, 0.03, 0.1, 0.25, 0.5])
SIZES = np.array([1, 2, 4, 8, 16, 32, 64, 128])


class Lines:
    """Lines (cut at \\n) with a word, of the texts of a chunk."""

    def __init__(self, words: Words):
        data = words.data
        cut = np.flatnonzero(data == 0x0A)
        begin = np.unique(np.concatenate([words.offsets[:-1], cut + 1]))
        begin = begin[begin < len(data)]
        end = np.append(begin[1:], len(data)) if len(begin) else begin
        end = np.where((end > begin) & (data[end - 1] == 0x0A), end - 1, end) if len(begin) else end
        a, b = np.searchsorted(words.start, begin), np.searchsorted(words.start, end)
        some = b > a
        self.begin, self.end, self.a, self.b = begin[some], end[some], a[some], b[some]
        self.text = np.searchsorted(words.offsets, self.begin, "right") - 1
        self.first = np.searchsorted(self.text, np.arange(len(words.first)))
        self.hash = words.spans(self.begin, self.end)
        key = mix(self.hash ^ mix(self.text.astype(np.uint64) + np.uint64(1)))
        _, at = np.unique(key, return_index=True)
        self.repeats = np.ones(len(key), bool)
        self.repeats[at] = False


def repeated_words(words: Words) -> np.ndarray:
    """Whether each word lies in a 3-word window that its text holds twice or more."""
    n = len(words.start)
    out = np.zeros(n + 1, np.int32)
    if n >= 3:
        text = words.texts()
        fits = text[2:] == text[:-2]
        key = mix(windows(words.hashes(), 3) ^ mix(text[:-2].astype(np.uint64) + np.uint64(1)))[fits]
        at = np.flatnonzero(fits)
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        at = at[count[inverse] > 1]
        np.add.at(out, at, 1)
        np.add.at(out, at + 3, -1)
    return np.cumsum(out[:-1]) > 0


def _sum(mask: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(mask)])


def features(words: Words, lines: Lines, repeated: np.ndarray) -> np.ndarray:
    """Active feature numbers, one column a kind of feature."""
    data, a, b, begin, end = words.data, lines.a, lines.b, lines.begin, lines.end
    size = np.maximum(1, end - begin)
    n = b - a

    def part(mask):
        total = _sum(mask[data])
        return total[end] - total[begin]

    upper, lower = part(UPPER), part(LOWER)
    letters = np.concatenate([[0], np.cumsum(words.end - words.start)])
    again = _sum(repeated)
    at = np.arange(len(a)) - lines.first[lines.text]
    count = np.diff(lines.first)[lines.text]
    columns = [
        (np.searchsorted(CUTS, part(SYMBOL) / n), 6),
        (np.searchsorted(CUTS, part(OTHER) / n), 6),
        (np.searchsorted(CUTS, upper / np.maximum(1, upper + lower)), 6),
        (np.searchsorted(CUTS, part(BAR) / n), 6),
        (np.searchsorted(CUTS, part(DIGIT) / size), 6),
        (np.searchsorted(SIZES, n), 9),
        (np.searchsorted(np.array([2, 3, 4, 5, 6, 8, 12]), (letters[b] - letters[a]) / n), 8),
        (np.searchsorted(CUTS, (again[b] - again[a]) / n), 6),
        (lines.repeats.astype(np.int64), 2),
        (np.isin(data[np.maximum(words.end[b - 1] - 1, 0)], STOP).astype(np.int64) if len(a) else np.zeros(0, np.int64), 2),
        (np.minimum(at, 2), 3),
        (np.searchsorted(SIZES, count), 9),
    ]
    base, out = 0, []
    for value, width in columns:
        out.append(value + base)
        base += width
    return np.column_stack(out) if len(a) else np.zeros((0, len(columns)), np.int64)


WIDTH = 6 * 5 + 9 + 8 + 6 + 2 + 2 + 3 + 9


class Field:
    """Weights by feature and label (0 boilerplate, 1 content), transitions and starts."""

    def __init__(self):
        self.weights, self.transition, self.start = np.zeros((WIDTH, 2)), np.zeros((2, 2)), np.array([0.0, 1e-6])
        self.weights[:, 1] = 1e-6

    def scores(self, active: np.ndarray) -> np.ndarray:
        return self.weights[active].sum(axis=1)

    def fit(self, active: np.ndarray, first: np.ndarray, gold: np.ndarray, weight: np.ndarray, rounds: int = 200, rate: float = 0.3, ridge: float = 1e-4) -> None:
        n = max(1, int(first.sum()))
        target = np.eye(2)[gold]
        follow = np.flatnonzero(~first[1:])
        pairs = np.zeros((2, 2))
        np.add.at(pairs, (gold[follow], gold[follow + 1]), 1)
        starts = target[first].sum(axis=0)
        square = [np.full_like(x, 1e-6) for x in (self.weights, self.transition, self.start)]
        for _ in range(rounds):
            g, pair, start = forward_backward(self.scores(active), first, self.transition, self.start)
            up = np.zeros_like(self.weights)
            for column in active.T:
                for j in (0, 1):
                    up[:, j] += np.bincount(column, (target - g)[:, j] * weight, WIDTH)
            steps = (up / n - ridge * self.weights, (pairs - pair) / n - ridge * self.transition, (starts - start) / n)
            for x, s, q in zip((self.weights, self.transition, self.start), steps, square):
                q += s**2
                x += rate * s / np.sqrt(q)


def learn(documents: DataFrame, labels: DataFrame, sample: int = 2000, text_bytes: int = 1 << 15, decodings: int = 3) -> Field | None:
    """The field fitted on a bounded sample of labelled documents; None without both qualities."""
    drawn = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("d")).agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("d"), "d").limit(sample)
    # ``sample`` rows of two numbers: broadcast, so that the texts aren't shuffled for them.
    rows = documents.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("d")).where(F.octet_length("text").between(1, text_bytes)).select("d", "quality", "text")
    # Ids that come often leave the same rows, whatever the order of the tasks.
    rows = rows.orderBy(F.xxhash64("d", "text"), "d", "text").limit(2 * sample).collect()
    rows = sorted((r.d, int(r.quality), r.text) for r in rows)
    if len({q for _, q, _ in rows}) < 2:
        return None
    texts = [t.encode() for *_, t in rows]
    words = Words(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
    lines = Lines(words)
    active = features(words, lines, repeated_words(words))
    first = np.zeros(len(active), bool)
    first[lines.first[:-1][np.diff(lines.first) > 0]] = True
    good = np.array([q > 0 for _, q, _ in rows])
    gold = good[lines.text].astype(np.int64)
    weight = 1.0 / np.sqrt(np.diff(lines.first)[lines.text])
    field = Field()
    field.fit(active, first, gold, weight)
    size = lines.b - lines.a
    for _ in range(decodings):
        # Lines go by their own decoding where it doesn't turn the text's label over: boilerplate within good
        # texts and content within poor ones train the field as what they are.
        score, before = field.scores(active), gold.copy()
        for t in np.flatnonzero(np.diff(lines.first)):
            a, b = lines.first[t], lines.first[t + 1]
            path = np.array(viterbi(score[a:b], field.transition, field.start), np.int64)
            share = (size[a:b] * path).sum() / size[a:b].sum()
            gold[a:b] = path if (share >= 0.5) == good[t] else good[t]
        if (gold == before).all():
            break
        field.fit(active, first, gold, weight, rounds=100)
    return field


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def measures(words: Words, field: Field | None, share: float):
    """The columns of COUNTS for the texts of a chunk."""
    lines, repeated = Lines(words), repeated_words(words)
    data, offsets, first = words.data, words.offsets, words.first
    lead = _sum((data & 0xC0) != 0x80)
    letters = np.concatenate([[0], np.cumsum(lead[words.end] - lead[words.start])])
    symbols, dup, rep = _sum(SYMBOL[data]), _sum(lines.repeats), _sum(repeated)
    n = np.diff(first)
    counts = [n, np.diff(letters[first]), np.diff(symbols[offsets]), np.diff(dup[lines.first]), np.diff(rep[first])]
    failed = (n < 50) | (100 * counts[4] > 50 * n)
    content = np.ones(len(n))
    if field is not None and len(lines.a):
        score = field.scores(features(words, lines, repeated))
        size = lines.b - lines.a
        for t in range(len(n)):
            a, b = lines.first[t], lines.first[t + 1]
            if b > a:
                path = np.array(viterbi(score[a:b], field.transition, field.start))
                content[t] = (size[a:b] * path).sum() / n[t]
    return [*counts, failed, ~failed & (content >= share), content]


def judge(documents: DataFrame, field: Field | None, share: float = 0.5, with_text: bool = False) -> DataFrame:
    """The measures of every row beside its other columns (and ``text``, if asked); one pass, no shuffle."""
    names = [c.split()[0] for c in COUNTS.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
    kept = [c for c in documents.columns if c != "text" or with_text]

    def run(batches):
        for batch in batches:
            for part, words, _ in chunks(batch, "text"):
                values = measures(words, field, share)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *[pa.array(v, k) for v, k in zip(values, kinds)]], [*kept, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name in kept)
    return documents.mapInArrow(run, f"{schema}, {COUNTS}")


def keep_good(documents: DataFrame, labels: DataFrame, share: float = 0.5) -> DataFrame:
    """The documents (all columns) that are kept."""
    names = documents.columns
    packed = documents.select("text", F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("doc"))
    good = judge(packed, learn(documents, labels), share, with_text=True).where("kept")
    return good.select(*["text" if c == "text" else F.col("doc")[c].alias(c) for c in names])


def op2_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    field = learn(documents, table(spark, sf_dir, "labels"))
    return judge(documents.select("doc_id", "text"), field)
