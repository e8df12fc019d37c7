"""Pipeline stages on odd rows, and the whole run."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


def folder(spark, tmp_path, rows, labels, bench):
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", bench, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


GOOD = "This is a plain sentence of words number{k}.\nAnd here follows another one, with commas{k} and some more words{k} in it."
BAD = "BUY!! NOW!! $$$ ### {k}\nCLICK!! HERE!! *** {k}"
ITEM = "which of these long named rivers flows through the quiet northern valley before it meets the sea"


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    rows = [(k, (GOOD if k % 2 else BAD).format(k=k), "en", "web", 10) for k in range(60)]
    rows += [(100, None, "en", "web", None), (101, "", "en", "web", 0), (102, GOOD.format(k=1), "en", "x", 5), (102, GOOD.format(k=1), "en", "x", 5), (None, GOOD.format(k=999), None, None, None)]
    rows += [(103, GOOD.format(k=7777) + " " + ITEM, "en", "y", 1), (104, GOOD.format(k=8888) + " Write to ann.lee@mail.example.com now.", "en", "y", 1)]
    return folder(spark, tmp_path_factory.mktemp("odd"), rows, [(k, k % 2, 0) for k in range(60)], [(1, ITEM)])


def test_stages_on_odd_rows(spark, place):
    docs = spark.read.parquet(f"{place}/documents.parquet").withColumns({"score": F.lit("clash"), "_score": F.lit(1), "n": F.lit(2), "hash": F.lit("h")})
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, place)
        assert out.columns == docs.columns, name
        docs = out.cache()
        kept[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    ids = lambda name: [d for d, _ in kept[name]]
    assert not {k for k in range(0, 60, 2)} & set(ids("quality_classifier")) and {k for k in range(1, 60, 2)} <= set(ids("quality_classifier"))
    assert ids("quality_classifier").count(102) == 2 and 102 not in ids("ngram_jaccard_join") and 1 in ids("ngram_jaccard_join") and None in ids("ngram_jaccard_join")
    assert 103 in ids("ngram_jaccard_join") and 103 not in ids("benchmark_decontamination") and len(ids("benchmark_decontamination")) == len(ids("ngram_jaccard_join")) - 1
    assert sorted(map(str, ids("pii"))) == sorted(map(str, ids("benchmark_decontamination")))
    before, after = dict(kept["benchmark_decontamination"]), dict(kept["pii"])
    assert {d for d in before if before[d] != after[d]} == {104} and "ann.lee" not in after[104]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, place)
    assert packed.count() == docs.count() and packed.agg(F.max("length")).first()[0] <= 2048


def test_run_keeps_only_its_last_result(spark, place, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "shared_dir", lambda _: str(tmp_path))
    out = corpus_pipeline.run(spark, place)
    (own,) = os.listdir(tmp_path)
    assert os.listdir(tmp_path / own) == ["4-best_fit_packing"] and out.count() > 30
    assert {104, 1, None} <= {r["doc_id"] for r in out.collect()} and not {103, 102, 0, 2} & {r["doc_id"] for r in out.collect()}


def test_stages_on_an_empty_table(spark, place):
    docs = spark.read.parquet(f"{place}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, place)
        assert out.count() == 0, name
        docs = out if name != "best_fit_packing" else docs
