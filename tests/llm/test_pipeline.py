from __future__ import annotations

import collections
from types import SimpleNamespace

import numpy as np

import corpus_pipeline as cp
from folium.llm import language, ngram_join, packing, pii, quality_rules


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(900, None, "en", "s", 0), (901, "1234 ...", None, None, None), (902, "", "de", "s", 0)], docs.schema)
    docs = docs.unionByName(extra).unionByName(docs.where("doc_id = 5"))
    before = {r.doc_id: r for r in docs.collect()}

    model = language.fit(language.sample(docs))
    scorer = language.Scorer(model)
    one = cp.language_stage(spark, docs, sf)
    told = {i: language.predict_text(scorer, model["langs"], r.text) for i, r in before.items()}
    assert {r.doc_id for r in one.collect()} == {i for i, (p, s) in told.items() if p != "und" and s >= cp.LEAST_SHARE}
    assert one.columns == docs.columns

    two = cp.quality_stage(spark, one, sf)
    assert {r.doc_id for r in two.collect()} == {r.doc_id for r in quality_rules.quality_rules(one).where("kept").collect()}
    assert two.columns == docs.columns

    three = cp.near_duplicate_stage(spark, two, sf)
    rows = {r.doc_id: set(ngram_join.shingles(r.text).tolist()) for r in two.collect()}
    ids, least = sorted(rows), {i: i for i in rows}
    for _ in range(8):
        for i in ids:
            for j in ids:
                if 5 * len(rows[i] & rows[j]) >= 4 * len(rows[i] | rows[j]):
                    least[i] = least[j] = min(least[i], least[j])
    assert collections.Counter(r.doc_id for r in three.collect()) == collections.Counter({i for i in ids if least[i] == i})
    assert three.columns == docs.columns

    four = cp.pii_stage(spark, three, sf).collect()
    assert len(four) == three.count() and all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in four)

    five = cp.packing_stage(spark, spark.createDataFrame(four, docs.schema), sf).collect()
    used = collections.Counter()
    for r in five:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= packing.CAPACITY and {r.doc_id for r in five} == {r.doc_id for r in four}


def test_near_duplicates_of_shared_ids_and_edges(spark):
    one, two = " ".join(f"alpha{i}" for i in range(60)), " ".join(f"beta{i}" for i in range(60))
    near = one.replace("alpha59", "omega")
    rows = [(1, one), (1, one), (1, two), (2, near), (3, two), (4, None), (4, None), (4, ""), (None, one), (None, one), (5, "  \n"), (6, "word " * 50_000)]
    docs = spark.createDataFrame([(i, t, None, "s", None, b"x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, set_key binary")
    got = cp.near_duplicate_stage(spark, docs, "")
    assert got.columns == cp.COLUMNS
    want = [(1, one), (1, two), (4, None), (4, ""), (None, one), (5, "  \n"), (6, rows[-1][1])]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    for stage in (cp.language_stage, cp.quality_stage, cp.near_duplicate_stage, cp.pii_stage, cp.packing_stage):
        assert stage(spark, docs.limit(0), "").collect() == []


def test_a_worker_keeps_one_large_object(spark):
    from folium.llm import common, language, tokens

    model = {"langs": ["en"], "tables": {k: language.Table([], np.zeros((0, 1))) for k in range(2)}}
    scorer = language.worker_scorer("call", SimpleNamespace(value=model))
    assert language.worker_scorer("call", SimpleNamespace(value=None)) is scorer
    encoder = tokens.encoder(tokens.default_path())  # the next operator's task in the same worker
    assert tokens.encoder(tokens.default_path()) is encoder and list(common._kept.values()) == [encoder]
    assert common.kept_by_worker(None) is None and not common._kept
