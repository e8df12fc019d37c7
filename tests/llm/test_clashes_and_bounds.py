"""Columns named like the operators' own, over-long texts that teach, and what stays in the shared folder."""

import os

from pyspark.sql import functions as F

import corpus_pipeline
from codebrook.llm import common, line_quality, ngram_join, pii

OWN = ("_n", "_sig", "_id", "_row", "_kept", "_again", "_text", "_TEXT2", "_quality", "_doc", "_hash", "__n")


def clashing(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in OWN})


def test_columns_named_like_the_operators_own(spark, data):
    text = " ".join(f"w{i}" for i in range(40))
    mail = "write to jane.roe@example.com or call 555-010-4477 today"
    docs = clashing(spark, [(1, text), (2, text + " more"), (3, mail), (4, "something else that stays as it is")])
    results = {
        "near": (ngram_join.representatives(docs, 5, 80), {1, 3, 4}),
        "replace": (pii.replace(docs, "key"), {1, 2, 3, 4}),
        "checked": (pii.checked(docs, "key"), {1, 2, 3, 4}),
        "clean": (corpus_pipeline.decontaminated(spark, docs, data), {1, 2, 3, 4}),
        "quality": (corpus_pipeline.quality(spark, docs, data), None),
    }
    for name, (got, ids) in results.items():
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert ids is None or {r["doc_id"] for r in rows} == ids, name
        assert all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in OWN), name


def test_colliding_entities_keep_clashing_columns(spark):
    docs = clashing(spark, [(1, "mail a@b.example now"), (2, "mail c@d.example now")])
    again = pii._with_again(docs, spark.createDataFrame([("email", pii.identity("key", "email", "a@b.example"), 1)], "kind string, original string, again int"), "key")
    assert again.columns[:-1] == docs.columns
    held = {r["doc_id"]: r[-1] for r in again.collect()}
    assert held[2] is None and [x["again"] for x in held[1]] == [1]


def test_one_long_document_does_not_silence_the_others(spark):
    good, bad = "This is a line of plain words that goes on.\nAnd here is another one.", "@@@ ### $$$\n%%% 111 222\n### @@@"
    ids = [r["doc_id"] for r in spark.range(80).select(F.col("id").alias("doc_id")).orderBy(F.xxhash64("doc_id")).collect()]
    first = next(i for i in ids if i % 2)
    rows = [(i, (good if i % 2 else bad) + (" word" * 4000 if i == first else "")) for i in ids]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    model = line_quality.fit(docs, labels, sample_bytes=10_000)
    scores = {r["doc_id"]: r["score"] for r in line_quality.score(docs, model).collect()}
    assert all((s >= 0.5) == bool(i % 2) for i, s in scores.items() if i != first)


def test_what_was_kept_goes_but_for_what_stays(spark):
    with common.transient(spark) as stay:
        common.keep(spark.range(5))
        gone = common._KEPT[-1]
        kept = stay(spark.range(7))
        there = common._KEPT[-1]
    where = lambda p: p.removeprefix("file:")
    assert not os.path.exists(where(gone)) and os.path.exists(where(there)) and kept.count() == 7


def test_long_repeats_are_the_doubled_windows(spark):
    """Level 0 alone keeps what did not double: a short repeat goes with it, a long one only with the levels above."""
    from codebrook.llm import substring_dedup

    long_, short = [f"l{i}" for i in range(300)], [f"s{i}" for i in range(15)]
    fill = lambda k, n: [f"f{k}_{i}" for i in range(n)]
    rows = [(1, long_ + fill(1, 20) + short), (2, fill(2, 30) + long_ + fill(3, 5)), (3, short + fill(4, 40)), (4, fill(5, 9) + long_[100:160] + fill(6, 3) + short)]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    levels = substring_dedup.repeated_runs(docs)
    of = lambda some: {r["doc_id"]: r["n_removed"] for r in substring_dedup.removed(docs, some).collect()}
    assert of(levels) == {1: 0, 2: 300, 3: 15, 4: 75}
    assert of(levels[:1]) == {1: 0, 2: 0, 3: 15, 4: 15}
    assert [of([lv])[2] for lv in levels] == [0] * (len(levels) - 1) + [300]
    assert of(levels[:3])[4] == 75 and of([levels[0]])[4] == 15


def test_runs_and_texts_travel_once(spark):
    """However many levels there are, texts and the runs of all levels meet by one exchange."""
    from codebrook.llm import substring_dedup

    long_ = " ".join(f"l{i}" for i in range(300))
    docs = spark.createDataFrame([(1, long_), (2, f"a {long_}"), (None, long_), (None, None), (3, "b")], "doc_id long, text string")
    levels = substring_dedup.repeated_runs(docs)
    out = substring_dedup.removed(docs, levels)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(levels) > 1 and plan.count("RepartitionByExpression") == 1 and "Aggregate" not in plan and "Join" not in plan
    assert sorted((r["doc_id"] or 0, r["n_removed"], r["longest_repeat"]) for r in out.collect()) == [(0, 0, 0), (0, 0, 0), (1, 0, 0), (2, 300, 300), (3, 0, 0)]


def test_rows_of_one_document_of_different_lengths(spark):
    """Runs of a document's longer row end with its shorter one."""
    from codebrook.llm import substring_dedup

    long_ = " ".join(f"l{i}" for i in range(60))
    docs = spark.createDataFrame([(1, long_), (2, long_), (2, "l0 l1 l2")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.removed(docs, substring_dedup.repeated_runs(docs)).collect())
    assert got == [(1, 60, 0), (2, 3, 0), (2, 60, 60)]
