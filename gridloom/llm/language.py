"""Language identification by a linear-chain conditional random field over words.

Each word of a text is labelled; its emission score sums weights of hashed features: all byte
n-grams of the word between border marks (those that touch a mark are its affixes) and the word
itself (the lexicon). Transitions between words are learned too, on chains that switch language,
so that code-switched text gets its stretches. Marginals of forward-backward, over whole texts,
are added up by text: the language with the largest sum is predicted and its share is the score.

The model is fitted on a sample of labelled rows: about ``per_language`` texts of each of at most
``most_languages`` languages (the most frequent ones), of a longer text its first ``text_chars`` characters, and
at most ``train_words`` words in all. All else covers every row and whole texts.

Defined cases: null texts and texts without a letter are ``und`` with score 0; rows with a null
language train nothing; without any row to learn from everything is ``und``; repeated rows count as
often as they come; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import table
from gridloom.llm.crf import forward_backward
from gridloom.llm.textkit import LOWER_BYTE, Words, chunks, mix

LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
MARKS = (0x02, 0x03)
STEP = np.uint64(0x9E3779B97F4A7C15)


class Features:
    """Hashed features of the distinct words of a chunk: ``slot`` (feature numbers, all words one
    after another), ``first`` (where each distinct word's begin), ``word`` (for each word of the
    chunk, its distinct word)."""

    def __init__(self, words: Words, bits: int, orders: int):
        h = words.hashes(LOWER_BYTE)
        _, where, self.word = np.unique(h, return_index=True, return_inverse=True)
        a, b = words.start[where], words.end[where]
        size = b - a + 2
        begin = np.concatenate([[0], np.cumsum(size)])
        n = int(begin[-1])
        inner = np.arange(n) - np.repeat(begin[:-1], size)
        source = np.repeat(a - 1, size) + inner
        flat = words.data[np.clip(source, 0, max(0, len(words.data) - 1))].copy() if n else np.zeros(0, np.uint8)
        flat[begin[:-1]], flat[begin[1:] - 1] = MARKS
        left = np.repeat(size, size) - inner  # bytes from here to the end of the word
        code = LOWER_BYTE[flat]
        slots, owners = [h[where]], [np.arange(len(where))]
        gram = code
        owner = np.repeat(np.arange(len(where)), size)
        for order in range(1, orders + 1):
            if order > 1:
                gram = gram[:-1] * STEP + code[order - 1 :] if len(gram) else gram
            fits = left[: len(gram)] >= order
            slots.append(mix(gram[fits] + np.uint64(order)))
            owners.append(owner[: len(gram)][fits])
        slot, owner = np.concatenate(slots) & np.uint64((1 << bits) - 1), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        self.slot, self.first, self.n = slot[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(where))), len(where)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Scores of the distinct words. A sum is divided by the root of the number of features."""
        if not self.n:
            return np.zeros((0, weights.shape[1]))
        return np.add.reduceat(weights[self.slot], self.first, axis=0) / self.scale()[:, None]

    def scale(self) -> np.ndarray:
        return np.sqrt(np.diff(np.concatenate([self.first, [len(self.slot)]])))


class Model:
    def __init__(self, languages: list[str], bits: int, orders: int):
        k = len(languages)
        self.languages, self.bits, self.orders = languages, bits, orders
        self.weights, self.transition, self.start = np.zeros((1 << bits, k), np.float32), np.zeros((k, k)), np.zeros(k)

    def marginals(self, words: Words) -> np.ndarray:
        f = Features(words, self.bits, self.orders)
        first = np.zeros(len(words.start), bool)
        first[words.first[:-1][np.diff(words.first) > 0]] = True
        return forward_backward(f.scores(self.weights)[f.word].astype(np.float64), first, self.transition, self.start)[0]


def as_words(texts: list[bytes]) -> Words:
    return Words(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))


def fit(texts: list[bytes], labels: list[str], bits: int = 18, orders: int = 4, segment: int = 40, train_words: int = 300_000, rounds: int = 40, rate: float = 0.5, seed: int = 5) -> Model:
    """Maximises the conditional likelihood of one chain of language-switching segments (about
    ``segment`` words each, in random order) by AdaGrad."""
    languages = sorted(set(labels))
    model = Model(languages, bits, orders)
    rng = np.random.Generator(np.random.PCG64(seed))
    code = {name: i for i, name in enumerate(languages)}
    segments = []
    for text, label in zip(texts, labels):
        w = text.split()
        at = 0
        while at < len(w):
            n = int(rng.geometric(1 / segment))
            segments.append((w[at : at + n], code[label]))
            at += n
    chain, gold = [], []
    for i in rng.permutation(len(segments)):
        w, label = segments[i]
        chain += w
        gold += [label] * len(w)
        if len(chain) >= train_words:
            break
    if not chain or len(languages) < 2:
        return model
    words = as_words([b" ".join(chain)])
    f, k, gold = Features(words, bits, orders), len(languages), np.array(gold)
    first = np.zeros(len(gold), bool)
    first[0] = True
    target = np.eye(k)[gold]
    pairs = np.zeros((k, k))
    np.add.at(pairs, (gold[:-1], gold[1:]), 1)
    w = np.zeros((1 << bits, k))
    square, square_t = np.full_like(w, 1e-6), np.full((k, k), 1e-6)
    spread = np.diff(np.concatenate([f.first, [len(f.slot)]]))
    by_word, by_slot, scale = np.argsort(f.word, kind="stable"), np.argsort(f.slot, kind="stable"), f.scale()
    word_at = np.searchsorted(f.word[by_word], np.arange(f.n))
    owner = np.repeat(np.arange(f.n), spread)[by_slot]
    slots, slot_at = np.unique(f.slot[by_slot], return_index=True)
    for _ in range(rounds):
        g, pair, _ = forward_backward(f.scores(w)[f.word], first, model.transition, model.start)
        up = np.add.reduceat((target - g)[by_word], word_at, axis=0) / scale[:, None]
        up = np.add.reduceat(up[owner], slot_at, axis=0) / len(gold) - 1e-7 * w[slots]
        square[slots] += up**2
        w[slots] += rate * up / np.sqrt(square[slots])
        up = (pairs - pair) / len(gold)
        square_t += up**2
        model.transition += rate * up / np.sqrt(square_t)
    model.weights = w.astype(np.float32)
    return model


def held_out(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2


def training_rows(documents: DataFrame, per_language: int, text_chars: int, most_languages: int) -> tuple[list[bytes], list[str]]:
    """Texts and languages of the sample, drawn by a hash of the id at one rate a language.

    The rates, one number for each of at most ``most_languages`` languages, are a literal of the plan, so that the
    drawing is one scan without a shuffle."""
    rows = documents.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(), F.lit(False)))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not counts:
        return [], []
    per_language = min(per_language, 6000 // len(counts) + 1)  # the sample in all stays under 12,000 texts
    every = documents.sparkSession.createDataFrame([(r.lang, max(1, r.n // per_language)) for r in counts], "l string, every long")
    drawn = rows.join(F.broadcast(every), F.col("lang") == F.col("l")).where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("every")) == 0)
    found = drawn.select("doc_id", F.substring("text", 1, text_chars).alias("text"), "lang")
    # Where one id has very many rows, the hash draws all of them or none: the least hashes of the texts stay.
    found = found.orderBy(F.xxhash64("doc_id", "text", F.lit(4)), "doc_id", "text", "lang").limit(2 * per_language * len(counts))
    found = sorted((r.doc_id is None, r.doc_id or 0, r.text, r.lang) for r in found.collect())
    return [t.encode() for _, _, t, _ in found], [lang for *_, lang in found]


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; one pass, no shuffle."""

    def run(batches):
        names = np.array([*(model.languages if model else []), "und"], object)
        for batch in batches:
            for part, words, valid in chunks(batch, "text"):
                n = part.num_rows
                share = np.zeros((n, max(1, len(names) - 1)))
                if model is not None and len(words.start):
                    g = model.marginals(words)
                    letters = np.concatenate([[0], np.cumsum(LETTER[words.data])])
                    g[letters[words.end] == letters[words.start]] = 0
                    some = np.flatnonzero(np.diff(words.first))
                    share[some] = np.add.reduceat(g, words.first[some], axis=0)
                total = share.sum(axis=1)
                best = share.argmax(axis=1)
                for t in range(n):
                    if total[t] > 0:
                        data = words.data[words.offsets[t] : words.offsets[t + 1]]
                        if not LETTER[:128][data[data < 128]].any() and not any(c.isalpha() for c in data.tobytes().decode()):
                            total[t] = 0
                known = total > 0
                score = np.where(known, np.clip(share[np.arange(n), best] / np.where(known, total, 1), 0, 1), 0.0)
                pred = names[np.where(known, best, len(names) - 1)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def learn(documents: DataFrame, per_language: int = 300, text_chars: int = 1 << 12, most_languages: int = 500) -> Model | None:
    texts, labels = training_rows(documents, per_language, text_chars, most_languages)
    # With many languages fewer hash slots, so that the weights stay under 16 million numbers.
    return fit(texts, labels, bits=min(18, ((1 << 24) // max(1, len(set(labels)))).bit_length() - 1)) if texts else None


def op3_word_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return identify(documents, learn(documents))
