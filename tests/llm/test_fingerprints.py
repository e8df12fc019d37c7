"""Fingerprints against exact sets of shingles."""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from codebrook.llm import fingerprints


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def against(rows, found, k=fingerprints.K):
    """`found` against whole texts, in descending order of ids, those without one last."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    by_id = {r["doc_id"]: r for r in found}
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        row = by_id[doc_id]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for got, want in ((row["near_edited"], jaccard(shingles(text), shingles(edited))), (row["near_next"], jaccard(shingles(text), shingles(after)))):
            exact = len(shingles(text) | shingles(edited) | shingles(after)) < k
            assert abs(got - want) < (1e-9 if exact else 0.2)


def test_odd_documents(spark):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 50, n))
    rows = [(i, text(int(rng.integers(0, 60)))) for i in range(40)] + [(50, None), (51, ""), (52, "ça é\tü"), (53, "one"), (54, text(5000)), (None, "a b c d e f")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fingerprint string")
    found = fingerprints.compared(docs).collect()
    assert len(found) == len(rows)
    against(rows, found)


def test_single_and_empty(spark):
    one = fingerprints.compared(spark.createDataFrame([(7, "a b c d e f g")], "doc_id long, text string")).collect()
    assert one[0]["near_next"] == 1.0 and one[0]["edited_sha256"] == hashlib.sha256(b"a b c da b c ").hexdigest()
    assert fingerprints.compared(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows_and_equal_texts(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "x")]
    found = fingerprints.compared(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 4 and len({r["fingerprint"] for r in found if r["n_chars"] == 11}) == 1


def test_over_the_corpus(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    against([(r["doc_id"], r["text"]) for r in docs.collect()], fingerprints.compared(docs).collect())


def test_merged_is_the_sketch_of_the_union(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 30, 80)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    prints = fingerprints.fingerprints(docs).withColumn("part", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3))
    found = {r["part"]: r for r in fingerprints.merged(prints, "part").collect()}
    assert set(found) == {None, 1, 2}
    for part, row in found.items():
        own = [t for i, t in enumerate(texts) if (i % 3 or None) == part]
        h, first = fingerprints.sketches(pa.array(own))
        assert row["fingerprint"] == fingerprints.encoded((np.unique(h)[: fingerprints.K], np.array([0, min(len(np.unique(h)), fingerprints.K)])))[0]
        true = len(set().union(*map(shingles, own)))
        assert abs(row["distinct"] - true) < 0.35 * true


def test_containment():
    part, whole = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(100))
    a, b = (fingerprints.sketches(pa.array([t])) for t in (part, whole))
    near, inside, distinct = fingerprints.likeness(a, b)
    assert (near[0], inside[0], distinct[0]) == (56 / 96, 1.0, 56)
