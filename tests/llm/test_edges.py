"""Nulls, empty and very long texts, repeated rows, empty tables and extra columns, for every operator."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.llm import extraction, jaccard, language, mixing, packing, quality, sharding, substrings, vectors, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = np.random.Generator(np.random.PCG64(1))
VOCABULARY = ["".join(RNG.choice(list("abcdefghijklmnop"), 5)) for _ in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, spans int, key string, mix_epoch string, _tokens int, kept string, doc string"


def prose(n: int) -> list[str]:
    return [str(w) for w in RNG.choice(VOCABULARY, n)]


def _corpus() -> list[tuple]:
    base = prose(300)
    near = base.copy()
    near[150] = "changed"
    passage = prose(60)
    texts = [
        " ".join(base), " ".join(base), " ".join(near), None, "", "   \n\t ", "one", "one", "Two words", "a b c d",
        " ".join(prose(80) + passage + prose(40)), " ".join(prose(30) + passage), " ".join(prose(50)).upper(), "\n".join([" ".join(prose(12))] * 9),
        " ".join(prose(30_000)), "ünïcödé ßtraße 漢字   x", "12 34 --", "%%% $$$ ### *** " * 30, " ".join(passage * 2),
    ]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[4], (None, "no id " * 20, "en", "a", 1), (None, None, None, None, None)]
    return [(*r, "clash", 7, "clash", "clash", 9, "clash", "clash") for r in rows]


ROWS = _corpus()


def corpus() -> list[tuple]:
    return ROWS


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def test_sharding(docs, none):
    got = sharding.assign_table(docs, 24).toPandas()
    assert len(got) == len(corpus()) and sharding.assign_table(none).count() == 0
    for r, group in got.groupby("shard"):
        assert sorted(group.slot) == list(range(len(group)))
    assert ((got.shard == got.grown_shard) | (got.grown_shard == 24)).all()
    sizes = {(None if pd.isna(d) else int(d)): s for d, s in zip(got.doc_id, got["size"])}
    assert sizes[3] == 8 and sizes[15] == len("ünïcödé ßtraße 漢字   x".encode()) + 8
    crc = {int(d): c for d, c in zip(got.doc_id, got.text_crc32) if not pd.isna(d)}
    assert crc[6] == zlib.crc32(b"one") and pd.isna(crc[3])


def test_sharding_moves_only_where_weights_change(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "k")
    tree = sharding.topology(10, racks=2, per_rack=3)
    heavier = [[[(s, 3.0 if s == 4 else w) for s, w in rack] for rack in region] for region in tree]
    both = sharding.assign(sharding.assign(keys, ["k"], tree, "a"), ["k"], heavier, "b").toPandas()
    region = {s: i for i, r in enumerate(tree) for rack in r for s, _ in rack}
    moved = both[both.a != both.b]
    assert len(moved) and all(region[b] == region[4] for b in moved.b)  # only into the region that grew
    share = both.b.value_counts(normalize=True)
    assert abs(share[4] / share[0] - 3) < 0.5
    grown = sharding.assign(keys, ["k"], sharding.add_shard(tree, 2.0), "c").toPandas()
    assert (grown.c[grown.c != both.a] == 10).all() and abs((grown.c == 10).mean() - 2 / 12) < 0.02


def xx64(values, seed=42):
    """Spark's xxhash64 of longs and ints (an int: its 4 bytes), chained from left to right."""
    import struct

    import xxhash

    for fmt, v in values:
        seed = seed if v is None else xxhash.xxh64_intdigest(struct.pack(fmt, v), seed)
    return seed


def test_sharding_against_brute_force(spark):
    """The whole tree in plain Python: every level's draws, shard by shard, for several sizes of one tree."""
    ids = [None, 0, 1, -5, 2**40, *range(100, 400)]
    d = spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string")

    def down(key, tree):
        def draw(level, parent, i, weight):
            h = xx64([("<q", key), ("<i", level), ("<i", parent), ("<i", i)])
            return -np.log(((h >> 11) + 0.5) / 2.0**53) / weight

        weight = lambda node: node[1] if isinstance(node, tuple) else sum(map(weight, node))
        racks = [rack for region in tree for rack in region]
        region = min(range(len(tree)), key=lambda i: draw(0, 0, i, weight(tree[i])))
        rack = sum(map(len, tree[:region])) + min(range(len(tree[region])), key=lambda i: draw(1, region, i, weight(tree[region][i])))
        return racks[rack][min(range(len(racks[rack])), key=lambda i: draw(2, rack, i, racks[rack][i][1]))][0]

    before = None
    for n in (24, 25, 26):
        got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.assign_table(d, n).collect()}
        assert got == {i: (down(i, sharding.grown(n)), down(i, sharding.grown(n + 1))) for i in ids}
        assert before is None or before == {i: s for i, (s, _) in got.items()}
        before = {i: g for i, (_, g) in got.items()}
    with pytest.raises(ValueError):
        sharding.assign_table(d, 23)


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(0, 1, 0), (12, 0, 0), (17, 0, 0), (10, 1, 0), (99, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    field = quality.learn(docs, labels)
    got = quality.judge(docs.select("doc_id", "text"), field).toPandas()
    want = collections.Counter()
    for _, t, *_ in corpus():
        w = words(t)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[(len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), failed)] += 1
    have = collections.Counter(zip(got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words, got.base_failed))
    assert have == want and not (got.kept & got.base_failed).any()
    assert quality.judge(none.select("doc_id", "text"), field).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == got.kept.sum()
    assert quality.learn(docs, labels.where("quality = 1")) is None and quality.learn(none, labels) is None


def test_fields_against_enumeration():
    """Marginals, pair sums and the best path of several chains, against all label sequences."""
    import itertools

    from gridloom.llm.crf import forward_backward, viterbi

    rng = np.random.Generator(np.random.PCG64(21))
    k, lengths = 3, [5, 1, 4]
    score, transition, start = rng.normal(0, 2, (10, k)), rng.normal(0, 1, (k, k)), rng.normal(0, 1, k)
    first = np.zeros(10, bool)
    first[[0, 5, 6]] = True
    g, pair, begin = forward_backward(score, first, transition, start, size=3)
    want, pairs, begins, at = np.zeros((10, k)), np.zeros((k, k)), np.zeros(k), 0
    for n in lengths:
        paths = list(itertools.product(range(k), repeat=n))
        value = np.array([start[y[0]] + sum(score[at + i, y[i]] for i in range(n)) + sum(transition[a, b] for a, b in zip(y, y[1:])) for y in paths])
        assert tuple(viterbi(score[at : at + n], transition, start)) == paths[value.argmax()]
        p = np.exp(value - value.max())
        for y, q in zip(paths, p / p.sum()):
            for i in range(n):
                want[at + i, y[i]] += q
            begins[y[0]] += q
            for a, b in zip(y, y[1:]):
                pairs[a, b] += q
        at += n
    assert np.allclose(g, want) and np.allclose(pair, pairs) and np.allclose(begin, begins)


def test_quality_labels_lines_and_holds_out(spark):
    """Texts that mix both kinds of lines: their share of content; and verdicts on texts that weren't learned from."""
    good = lambda: " ".join(prose(12)).capitalize() + "."
    poor = lambda: " | ".join(w.upper() + "###" for w in prose(12))
    lines = [[good() if i % 3 else poor() for _ in range(8)] for i in range(150)]
    for i in range(0, 40, 2):  # a few lines of the other kind within learned texts
        lines[i][3] = poor() if i % 3 else good()
    lines += [[good() for _ in range(c)] + [poor() for _ in range(8 - c)] for c in (6, 3, 5, 2)]
    d = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(lines)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(d, quality.learn(d, labels)).collect()}
    assert all(got[i].kept == (i % 3 > 0) for i in range(100, 150))
    want = [sum(len(words(x)) for x in t if "#" not in x) / sum(len(words(x)) for x in t) for t in lines]
    for i, t in enumerate(lines[150:], 150):
        assert abs(got[i].content_share - want[i]) < 1e-9 and got[i].kept == (want[i] >= 0.5)


def test_language(spark, docs, none):
    en, de = "the cat and the dog with this house of that".split(), "der hund und die katze mit dem haus von einer".split()
    rows = []
    for i in range(240):
        name, pool = [("en", en), ("de", de)][i % 2]
        rows.append((i, " ".join(RNG.choice(pool, 30)), name))
    learned = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(learned)
    got = language.identify(learned.withColumn("lang", F.lit("xx")), model).toPandas()
    assert all(p == ("en", "de")[int(i) % 2] for i, p in zip(got.doc_id, got.lang_pred)) and got.score.between(0, 1).all()
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]
    mixed = language.as_words([" ".join(en[:6] + de[:6] + en[:6]).encode()])
    best = model.marginals(mixed).argmax(axis=1)
    assert best.tolist() == [model.languages.index(x) for x in ["en"] * 6 + ["de"] * 6 + ["en"] * 6]
    odd = language.identify(docs, model).toPandas()
    by = {int(d): p for d, p in zip(odd.doc_id, odd.lang_pred) if not pd.isna(d)}
    assert len(odd) == len(corpus()) and by[3] == by[4] == by[5] == by[16] == "und" and by[15] in ("en", "de")
    assert language.learn(none) is None and set(language.identify(docs, None).toPandas().lang_pred) == {"und"}


def brute_components(rows, k, num):
    sets = {}
    for i, (d, t, *_) in enumerate(rows):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(t)]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            common = len(sets[i] & sets[j])
            if same_id or (sets[i] and sets[j] and 100 * common >= num * (len(sets[i]) + len(sets[j]) - common)):
                parent[find(i)] = find(j)
    low = {}
    for i in sets:
        if rows[i][0] is not None:
            low[find(i)] = min(low.get(find(i), 1 << 60), rows[i][0])
    return collections.Counter((rows[i][0], len(sets[i]), low.get(find(i))) for i in sets)


@pytest.mark.parametrize("k,threshold", [(4, 0.85), (5, 0.8)])
def test_jaccard(docs, none, k, threshold):
    got = jaccard.join_components(docs, k, threshold).toPandas()
    have = collections.Counter((None if pd.isna(a) else int(a), int(n), None if pd.isna(c) else int(c)) for a, n, c in zip(got.doc_id, got.n_shingles, got.component_id))
    assert have == brute_components(corpus(), k, round(threshold * 100))
    assert jaccard.join_components(none, k, threshold).count() == 0


@pytest.mark.parametrize("threshold,floor", [(0.8, 99), (0.8, 2), (0.5, 2)])
def test_jaccard_of_small_sets(spark, threshold, floor):
    """Sets of n shingles and the same with one more; with all tokens rare, and with all frequent."""
    rows = []
    for n in (1, 2, 3, 4, 5, 6):
        text = prose(n + 5)
        rows += [(len(rows), " ".join(text[:-1])), (len(rows) + 1, " ".join(text)), (len(rows) + 2, " ".join([f"x{n}", *text[:-1]]))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.join_components(d, 5, threshold, floor=floor).toPandas()
    assert collections.Counter(zip(got.doc_id, got.n_shingles, got.component_id)) == brute_components(rows, 5, round(threshold * 100))
    if floor == 99:
        assert jaccard.keep_one(d, 5, threshold).count() == len(rows) - 6  # of n = 4, 5 and 6


def test_jaccard_keeps_one(docs):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert ids[0] == 1 and not ids[1] and not ids[2] and ids[3] == 1 and ids[None] == 2


def test_jaccard_groups_and_frequent_tokens(spark):
    """A hub with many near copies, some far from each other, a chain, and a common passage."""
    rng = np.random.Generator(np.random.PCG64(7))
    hub, shared = prose(200), prose(80)
    rows = [(i, " ".join(hub if i % 60 == 30 else [w if rng.random() > 0.009 else f"x{i}" for w in hub])) for i in range(120)]
    chain = prose(150)
    for i in range(120, 135):
        chain = chain.copy()
        chain[(i * 37) % 150] = f"c{i}"
        rows.append((i, " ".join(chain)))
    rows += [(i, " ".join(shared + prose(12))) for i in range(135, 160)] + [(i, " ".join(shared + prose(200))) for i in range(160, 180)]
    got = jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 0.85, floor=6).toPandas()
    assert collections.Counter(zip(got.doc_id, got.n_shingles, got.component_id)) == brute_components(rows, 4, 85)


@pytest.mark.parametrize("most", [27, 3])
def test_jaccard_without_ids_and_with_shared_ids(spark, most):
    """A chain through rows without an id, equal rows without one, and an id with several texts."""
    a = prose(40)
    b, c = [*a[:-1], "x1"], [*a[1:-1], "x1"]  # a and c are linked through b alone
    d, e = prose(40), prose(40)
    texts = [(1, a), (None, b), (None, b), (2, c), (None, d), (None, [*d[:-1], "x2"]), (5, prose(30)), (3, e), (5, e), (5, [*a[:-1], "x3"])]
    rows = [(i, " ".join(t)) for i, t in texts] + [(None, None), (None, "")]
    got = jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 0.85, most=most).toPandas()
    have = collections.Counter((None if pd.isna(x) else int(x), int(n), None if pd.isna(y) else int(y)) for x, n, y in got.itertuples(index=False))
    assert have == brute_components(rows, 4, 85) and have[(2, 36, 1)] == have[(5, 27, 1)] == 1


def test_jaccard_pairs(spark):
    """All links, those between two members of one component that aren't their leader's too."""
    rng = np.random.Generator(np.random.PCG64(11))
    hub = prose(120)
    rows = [(i, " ".join(w if rng.random() > 0.012 else f"y{i}" for w in hub)) for i in range(40)]
    rows += [(40 + i, rows[i][1]) for i in range(5)] + [(50 + i, " ".join(hub[:60] + prose(60))) for i in range(5)] + [(60, None)]
    pairs, members = jaccard.join_pairs(spark.createDataFrame(rows, "doc_id long, text string"), 4, 0.85, floor=6)
    rep = dict((r.doc_id, r.rep) for r in members.collect())
    sets = {d: {tuple(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)} for d, t in rows if t}
    assert rep.keys() == sets.keys() and all(sets[d] == sets[r] for d, r in rep.items())
    reps = sorted(set(rep.values()))
    want = [(a, b) for a in reps for b in reps if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert sorted((r.a, r.b) for r in pairs.collect()) == want and len(want) > 2 * len(reps)


def test_prefix_signatures_share_one_for_every_linked_pair():
    rng = np.random.Generator(np.random.PCG64(3))
    for _ in range(300):
        n = int(rng.integers(6, 200))
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        lost = int(rng.integers(0, jaccard.lacks(len(x), 0.8) + 1))
        y = np.unique(np.concatenate([rng.permutation(x)[lost:], rng.integers(0, 2**63, int(rng.integers(0, 5)), dtype=np.uint64)]))
        common = len(np.intersect1d(x, y))
        if common < 0.8 * (len(x) + len(y) - common):
            continue
        cut = np.uint64(int(2**63 * rng.random()))
        a, b = (jaccard.prefix_signatures(s[s < cut], s[s >= cut], 0.8) for s in (x, y))
        assert len(np.intersect1d(a, b))


@pytest.mark.parametrize("how", [{}, {"shard_bytes": 1 << 40}, {"shard_bytes": 4000, "most": 3, "limit": 5000}])
def test_substrings(docs, none, how):
    got = substrings.digests(docs, 35, **how).toPandas()
    all_ = [words(t) for _, t, *_ in corpus()]
    count = collections.Counter(tuple(w[k : k + 35]) for w in all_ for k in range(len(w) - 34))
    want = collections.Counter()
    for (d, *_), w in zip(corpus(), all_):
        gone = set()
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone |= set(range(k, k + 35))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[(d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert collections.Counter((None if pd.isna(a) else int(a), b, c, h) for a, b, c, h in got.itertuples(index=False)) == want
    assert substrings.digests(none, 35, **how).count() == 0


def test_substrings_are_cut(docs, none):
    cut = substrings.remove(docs, window=35)
    assert cut.columns == docs.columns and cut.count() == len(corpus()) and substrings.remove(none).count() == 0
    by = {r.doc_id: r for r in cut.collect()}
    assert by[0].text == "" and by[3].text is None and by[6].text == "one" and by[14].text == corpus()[14][1] and by[10].n_chars == len(by[10].text) < corpus()[10][4]


def test_substrings_of_random_overlaps(spark):
    """Few words, so that windows recur in all ways, within one document too; shards of several sizes."""
    rng = np.random.Generator(np.random.PCG64(13))
    pieces = [[str(x) for x in rng.integers(0, 3, 9)] for _ in range(12)]
    texts = [[w for i in rng.integers(0, 12, int(rng.integers(0, 9))) for w in pieces[i]] for _ in range(60)] + [["a"] * 40, ["a"] * 7 + ["b"]]
    count = collections.Counter(tuple(w[k : k + 12]) for w in texts for k in range(len(w) - 11))
    want = {}
    for d, w in enumerate(texts):
        want[d] = len({k + j for k in range(len(w) - 11) if count[tuple(w[k : k + 12])] > 1 for j in range(12)})
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id long, text string")
    for size in (100, 2000, 1 << 30):
        got = substrings.digests(frame, 12, anchor=4, shard_bytes=size, limit=500)
        assert {r.doc_id: r.n_removed for r in got.collect()} == want and 0 < sum(want.values()) < sum(map(len, texts))


def test_only_the_automata_know_the_places(spark):
    """In one shard a passage leaves the confirmation with one place, whatever the number of its occurrences."""
    passage = prose(50)
    rows = [(i, " ".join([*prose(int(RNG.integers(5, 60))), *passage, *prose(20)])) for i in range(40)]
    frame = substrings.keyed(spark.createDataFrame(rows, "doc_id long, text string"), 1 << 30)
    passages = substrings.recurring(frame, 35, 8, 27).toPandas()
    assert passages.key.nunique() < 20 and not passages.alone.any()
    got = substrings.digests(frame, 35, shard_bytes=1 << 30).toPandas()
    assert (got.n_removed >= 50).all() and len(got) == 40
    hashes = [np.arange(10, 20, dtype=np.uint64), np.arange(12, 40, dtype=np.uint64)]
    for most in (1 << 20, 3):  # one code point a word, and two
        assert [g.sum() for g in substrings.occurrences(hashes, [hashes[0][3:8]], most)] == [5, 5]


def test_packing(docs, none):
    from tokenizers import Tokenizer

    got = packing.pack_documents(docs).toPandas()
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    want = collections.Counter()
    for d, t, *_ in corpus():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) - 2048 * (-(-len(ids) // 2048) - 1)
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(d, p, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    have = collections.Counter((None if pd.isna(a) else int(a), *r) for a, *r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))
    assert have == want and packing.pack_documents(none).count() == 0
    got = got.sort_values(["sequence_id", "offset"])
    end = got.offset + got.length
    assert end.max() <= 2048 and (got.offset == end.groupby(got.sequence_id).shift(1).fillna(0)).all()


def test_encoder_agrees_with_the_tokenizer():
    path = packing.vocabulary()
    for encoder in (packing.Encoder(path, keep=50), packing.Encoder(path, packing.same_ranks(path)), packing.Encoder(path, "[é漢]")):
        check_encoder(encoder)


def check_encoder(encoder):
    texts = ["a  b\n\n c", " lead", "trail  ", "don't we'll", "<|endoftext|> x", "x\x1cy   z", "漢字 émé 12½", "\r\n\t x", "", "x" + " " * 5000 + "é", "\n" * 999 + "q", "a" * 5000 + " \x1c" * 2000 + "b"]
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_the_quick_encoder_agrees_on_all_kinds_of_chunks():
    rng = np.random.Generator(np.random.PCG64(31))
    encoder = packing.Encoder(packing.vocabulary(), packing.same_ranks(packing.vocabulary()))
    assert encoder.quick
    ascii_ = "".join(map(chr, [9, 10, 13, *range(32, 127)]))
    pools = [ascii_, "ab", "the and", "aA1 .'", "==--__  ", "0123456789", "\r\n \t", "é漢٣²½ '\u0301\u00a0\u0085\u2028\u3000\u200b😀𝟘", "".join(map(chr, [*range(0x20, 0xD800, 7), *range(0xE000, 0x20000, 13)]))]
    texts = ["".join(rng.choice(list(pools[i % len(pools)]), int(rng.integers(1, 60)))) for i in range(7000)]
    got = encoder.encode(texts)
    assert got == [packing._bytes(e.ids) for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_bin_completion_finds_planted_packings():
    rng = np.random.Generator(np.random.PCG64(41))
    for bins, pieces in ((400, 6), (200, 8), (300, 3)):
        cuts = np.sort(np.array([rng.choice(2047, pieces - 1, replace=False) + 1 for _ in range(bins)]), axis=1)
        sizes = np.diff(np.column_stack([np.zeros(bins, int), cuts, np.full(bins, 2048)]), axis=1).ravel()
        plan = packing.pack(np.bincount(sizes, minlength=2049))
        assert sum(t for _, t in plan) == bins and all(sum(b) <= 2048 for b, _ in plan)


def test_bin_completion_is_optimal_on_small_cases():
    def least(items, capacity):
        items, best = sorted(items, reverse=True), [len(items)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for j in {b: j for j, b in enumerate(bins)}.values():
                if bins[j] >= items[i]:
                    go(i + 1, [*bins[:j], bins[j] - items[i], *bins[j + 1 :]])
            go(i + 1, [*bins, capacity - items[i]])

        go(0, [])
        return best[0]

    rng = np.random.Generator(np.random.PCG64(2))
    for _ in range(60):
        items = rng.integers(1, 30, int(rng.integers(1, 12))).tolist()
        counts = np.bincount(items, minlength=31)
        plan = packing.pack(counts, 30)
        assert sum(t for _, t in plan) == least(items, 30) >= packing.lower_bound(counts, 30)
        used = collections.Counter(x for b, t in plan for x in b * t)
        assert used == collections.Counter(items) and all(sum(b) <= 30 for b, _ in plan)


def test_bin_completion_takes_any_number_of_pieces():
    counts = np.zeros(2049, np.int64)
    counts[[300, 400, 500]] = 60
    plan = packing.pack(counts)
    assert sum(t for _, t in plan) == 36  # all bins hold 2,000
    assert collections.Counter(x for b, t in plan for x in b * t) == {300: 60, 400: 60, 500: 60} and all(sum(b) <= 2048 for b, _ in plan)
    short = np.bincount(np.random.Generator(np.random.PCG64(8)).integers(100, 411, 2000), minlength=2049)
    assert sum(t for _, t in packing.pack(short)) == packing.lower_bound(short, 2048)


def test_fillings_are_all_that_are_maximal():
    rng = np.random.Generator(np.random.PCG64(9))
    for _ in range(40):
        items = sorted(rng.integers(1, 20, int(rng.integers(2, 9))).tolist())
        big, rest, room = items[-1], items[:-1], int(rng.integers(0, 40))
        want = set()
        for chosen in range(1 << len(rest)):
            f = [x for i, x in enumerate(rest) if chosen >> i & 1]
            others = [x for i, x in enumerate(rest) if not chosen >> i & 1]
            if sum(f) <= room and all(sum(f) + x > room for x in others):
                want.add(tuple(sorted(f)))
        got = [tuple(sorted(f)) for f in packing.fillings(packing._Left(np.bincount(items, minlength=60)), room, big)]
        assert len(got) == len(want) and set(got) == want
        assert [sum(f) for f in got] == sorted(map(sum, got), reverse=True)


def test_mixing(docs, none):
    covered = mixing.mix(docs)
    assert sorted(covered.columns) == sorted(docs.columns) and covered.agg(F.min("_tokens"), F.max("_tokens")).first() == (9, 9)
    assert covered.select("doc_id", "text").distinct().count() == docs.select("doc_id", "text").distinct().count()
    assert mixing.mix(none).count() == 0
    few = mixing.mix(docs.where("text IS NULL"))
    assert few.count() == 2


@pytest.mark.parametrize("kind,names", [("string", ["a", "b", None]), ("int", [1, 2, None])])
def test_mixing_against_brute_force(spark, kind, names):
    """Which documents are used how often: blocks in hashed order, documents by hash, up to the budget."""
    rows = [(i, "w " * (3 + i % 17), names[0 if i % 10 else 1 + i % 20 // 10]) for i in range(700)]
    d = spark.createDataFrame(rows, f"doc_id long, text string, source {kind}")
    hashes = {r.doc_id: r.h for r in d.select("doc_id", F.xxhash64("doc_id", "text", F.lit(17)).alias("h")).collect()}
    for budget in (0.6, 1.0, 1.7):
        sizes = {s: sum(3 + i % 17 for i, _, t in rows if t == s) for s in names}
        _, w = mixing.solve([float(sizes[s]) for s in names], budget * sum(sizes.values()), 0.5, 2.0)
        want = collections.Counter()
        for s, share in zip(names, w):
            epochs = share * budget * sum(sizes.values()) / sizes[s]
            full, blocks = int(epochs + 1e-9), max(1, sizes[s] // 128)
            part, order = (epochs - full) * sizes[s], {}
            mine = [(i, hashes[i] % blocks) for i, _, t in rows if t == s]
            for b in {b for _, b in mine}:
                order[b] = xx64([("<q", b), ("<i", 18)])
                order[b] -= (order[b] >> 63) << 64
            for i, b in sorted(mine, key=lambda x: (order[x[1]], x[1], hashes[x[0]])):
                want[i] += full + (part > 0 and part >= 0.5)
                part -= 3 + i % 17
        got = collections.Counter(r.doc_id for r in mixing.mix(d, budget, block_tokens=128).collect())
        assert got == +want


def test_mixing_budgets(spark):
    rows = [(i, "w " * int(n), s) for i, (n, s) in enumerate([(20, "a")] * 900 + [(20, "b")] * 90 + [(20, None)] * 10)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for budget in (0.5, 1.0):
        got = mixing.mix(d, budget, block_tokens=256).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("mix_epoch").alias("e")).toPandas()
        tokens = [18000.0, 1800.0, 200.0]
        _, w = mixing.solve(tokens, budget * 20000, 0.5, 2.0)
        for s, x in zip(("a", "b", None), w):
            n = int(got.n[got.source.isna() if s is None else got.source == s].iloc[0])
            assert abs(20 * n - x * budget * 20000) <= 40
        assert got.e.max() <= 1
    tokens = [1000.0, 100.0, 10.0]
    t, w = mixing.solve(tokens, 1110, 0.7, 1e9)
    own, most = mixing.entropy(mixing.tempered(tokens, 1)), np.log(3)
    assert abs(mixing.entropy(w) - own - 0.7 * (most - own)) < 1e-6 and 0 < t < 1


def test_vectors(spark):
    rng = np.random.Generator(np.random.PCG64(4))
    base = rng.standard_normal((60, 16))
    vs = [base[i // 5] + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.12]) for i in range(300)]
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(vs)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, [None, *[1.0] * 15], 0), (304, vs[0].tolist(), None), (None, vs[0].tolist(), 0), (305, [], 0), (306, vs[0][:8].tolist(), 0), (307, [float("inf")] * 16, 1), rows[3]]
    rows += [(308, [*vs[9].tolist()[:5], None, *vs[9].tolist()[5:]], 0), (309, [*vs[9].tolist(), None], 0), (310, [None], 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit(1))
    got = vectors.near_vectors(d, 0.93, block_bytes=2048, queries=7).toPandas()
    ok = [i for i, (v, e, lab) in enumerate(rows) if v is not None and lab is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    n, parent = collections.Counter(), {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93:
                    n[a] += 1
                    n[b] += 1
                    parent[max(find(rows[a][0]), find(rows[b][0]))] = min(find(rows[a][0]), find(rows[b][0]))
    want = collections.Counter((r[0], n[i], find(r[0]) if r[0] is not None else None) for i, r in enumerate(rows))
    have = collections.Counter((None if pd.isna(a) else int(a), int(k), None if pd.isna(c) else int(c)) for a, k, c in zip(got.vec_id, got.n_links, got.component_id))
    assert have == want and sum(n.values()) > 100
    assert vectors.near_vectors(d.where("false")).count() == 0


def test_collision_counts_and_calibration():
    rng = np.random.Generator(np.random.PCG64(5))
    q, d = rng.standard_normal((7, 20)), rng.standard_normal((7, 33))
    assert (vectors.collisions(q, d, 0.4) == (abs(q[:, :, None] - d[:, None, :]) <= 0.4).sum(axis=0)).all()
    assert vectors.calibrated(40, 1.5, 1e-6) < vectors.calibrated(40, 1.5, 1e-2) < 40


PAGES = [
    (1, "u", "<html><head><title>t</title></head><body><nav><a href='/'>home</a></nav><article><h1>Head</h1><p>Caf&eacute;  &amp; the\n<b>bold</b> text<br>on.<p>Second &#x41; part</article><footer>foot</footer>", "Head\nCafé & the bold text on.\nSecond A part"),
    (2, "u", None, ""), (3, None, "", ""), (None, "u", "<p>", ""),
    (4, "u", "<body><div class='cookie-notice'>We use the cookies of this site and the like</div><main><p>The story of the day is in the news and it was on.</p><div class='comments'><p>I think that the story is on the way to it.</p></div><aside>The other story is in the list of it.</aside></main><form>Name <input></form>", "The story of the day is in the news and it was on."),
    (5, "u", "<body><div>" + "The people of the town were in the street and it was not the end of the day. " * 4 + "</div><div>Short one</div><p>" + "It is the end of the story and that is all there is to the tale of the town. " * 4 + "</p><ul><li><a href='x'>link one two three four</a></li></ul>", None),
    (6, "u", "<article>a<!-- no --><script>var x='</p>';</script><style>p{}</style>b<p title='a>b'>c &lt;d&gt;", "ab\nc <d>"),
]


def test_extraction(spark):
    d = spark.createDataFrame([p[:3] for p in PAGES], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = extraction.extract(d).toPandas()
    by = {None if pd.isna(i) else int(i): t for i, t in zip(got.page_id, got.text)}
    for i, _, _, want in PAGES:
        if want is not None:
            assert by[i] == want, (i, by[i])
    lines = by[5].split("\n")
    assert len(lines) == 3 and lines[1] == "Short one" and "link" not in by[5]
    assert (got.n_chars == got.text.str.len()).all() and extraction.extract(d.where("false")).count() == 0


def test_extraction_of_hostile_pages():
    for html in ("<" * 5000, "<a '" * 3000, "<div>" * 3000 + "x", "<!--" + "x" * 9999, "<p " + "a='b' " * 3000, "&" * 5000):
        assert isinstance(extraction.main_text(html), str)


def test_warc(spark):
    big = "x" * 1500
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", "é" * 500), (7, "u", "é" * 500), (8, "u", "y" * 999), (9, "u", "y" * 999), (2, "u", big), (None, "u", "z" * 2000), (10, "u", big + "\r\n\r\n" + VOCABULARY[0] * 20_000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    folder = warc.shared_path(spark, "test-warc")
    listed = warc.write_archives(warc.with_types(d), folder, size=40_000, sample=2000)
    got = warc.read_archives(listed, folder).toPandas()
    want = collections.Counter()
    for p, _, h in rows:
        data = (h or "").encode()
        same = [q for q, _, g in rows if (g or "").encode() == data and q is not None]
        kind = "revisit" if len(data) >= 1000 and same and p != max(same) else "response"
        if p is None:
            kind = "response"
        want[(p, len(data), hashlib.sha1(data).hexdigest(), kind, max(same) if kind == "revisit" else None)] += 1
    have = collections.Counter((None if pd.isna(a) else int(a), n, h, k, None if pd.isna(r) else int(r)) for a, n, h, k, r in got[["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]].itertuples(index=False))
    assert have == want
    assert warc.read_archives(warc.write_archives(warc.with_types(d.where("false")), folder), folder).count() == 0


def test_warc_agrees_with_its_sql(spark, tmp_path):
    import duckdb

    from gridloom.llm.queries import QUERIES, SQL

    name = "op7_dictionary_warc"
    rows = [(1, "http://a/ b\t", "x" * 1500), (2, None, "x" * 1500), (2, "u", "x" * 1500), (3, "u", "small"), (4, "u", "small"), (5, "", None), (6, "u", "é" * 500), (7, "u", "é" * 500), (8, "u", "y" * 999), (9, "u", "y" * 999), (None, "u", "z" * 2000), (10, "u", "w" * 2000), (None, "u", "w" * 2000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    found, got = con.execute(SQL[name]), QUERIES[name](spark, str(tmp_path))
    assert [c[0] for c in found.description] == got.columns
    want = collections.Counter(found.fetchall())
    assert collections.Counter(map(tuple, got.collect())) == want and len(want) == 13


def test_archives_are_standard_frames(spark):
    import struct

    import zstandard as zstd

    d = spark.createDataFrame([(i, "u", " ".join(prose(400))) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    folder = warc.shared_path(spark, "test-warc")
    names = [r.name for r in warc.write_archives(warc.with_types(d), folder).collect()]
    fs, root = warc.open_folder(folder)
    for name in names:
        raw = fs.open_input_stream(f"{root}/{name}").read()
        magic, n = struct.unpack("<II", raw[:8])
        assert magic == 0x184D2A5D
        out = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw[8 : 8 + n])).stream_reader(raw[8 + n :], read_across_frames=True).read()
        assert out.count(b"WARC/1.1\r\n") == 40 and raw[8 + n :].count(warc.FRAME) >= 40
