"""The corpus pipeline, stage by stage, on a small folder of tables."""

import collections
import re

import numpy as np
import pytest

import corpus_pipeline as cp

RNG = np.random.Generator(np.random.PCG64(9))
VOCABULARY = ["".join(RNG.choice(list("abcdefghijklmnop"), 6)) for _ in range(2000)]


def prose(n):
    return [str(w) for w in RNG.choice(VOCABULARY, n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    rows, labels = [], []
    passage = prose(70)
    for i in range(60):
        good = i % 4 != 3
        lines = [" ".join(prose(20)).capitalize() + "." if good else " ".join(w + "###" for w in prose(20)).upper() for _ in range(6)]
        rows.append((i, "\n".join(lines), "en", "big" if i < 50 else "small", 1))
        labels.append((i, int(good), 0))
    text = rows[0][1].split(" ")
    text[60] = "edited"
    rows += [(60, rows[0][1], "en", "big", 1), (61, " ".join(text), "en", "big", 1)]
    rows += [(62 + k, " ".join(prose(120) + passage + prose(30)) + ".", "en", "small", 1) for k in range(3)]
    rows += [(65, None, None, None, None), (66, "", "en", "big", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root, {r[0]: r[1] for r in rows}, " ".join(passage)


def test_stages(spark, folder):
    root, texts, passage = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns = docs.columns
    stages = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "source_mixing", "packing"]
    good = stages["quality_rules"](spark, docs, root).cache()
    assert good.columns == columns
    kept = {r.doc_id for r in good.collect()}
    assert kept == {i for i in texts if texts[i] and not re.search("###", texts[i])}
    single = stages["near_duplicates"](spark, good, root).cache()
    assert {r.doc_id for r in single.collect()} == kept - {60, 61} and single.columns == columns
    cut = stages["repeated_passages"](spark, single, root).cache()
    got = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == columns and set(got) == kept - {60, 61}
    assert all(passage not in got[i] and len(got[i].split()) == 150 for i in (62, 63, 64)) and all(got[i] == texts[i] for i in got if i < 60)
    mixed = stages["source_mixing"](spark, cut, root).cache()
    uses = collections.Counter(r.doc_id for r in mixed.collect())
    assert set(uses) == set(got) and sorted(mixed.columns) == sorted(columns) and max(uses.values()) == 2
    packed = stages["packing"](spark, mixed, root).toPandas()
    assert collections.Counter(packed[packed.piece == 0].doc_id) == uses
    end = packed.offset + packed.length
    assert end.max() <= 2048


def test_run_equals_its_stages(spark, folder):
    root, _, _ = folder
    got = cp.run(spark, root)
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, root)
    pick = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(pick).collect())) == sorted(map(tuple, docs.select(pick).collect()))
