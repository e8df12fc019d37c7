"""Brute-force twins of the learned operators, ids over a whole table, long texts and ties."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codebrook.llm import language_id, license_scan, line_quality, ngram_join, packing, quality_rules, substring_dedup
from codebrook.llm.registry import tokenizer_path

LONG = " ".join(f"word{i % 7000} runs{i}" for i in range(60_000))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_ids_of_all_documents_are_the_tokenizers():
    from pathlib import Path

    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    file = Path("/root/testdata/sf0.01/documents.parquet")
    if not file.exists():
        pytest.skip("no test data here")
    own, other = packing.encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = [t or "" for t in pq.read_table(file, columns=["text"]).column(0).to_pylist()]
    for text, ids in zip(texts, other.encode_batch(texts, add_special_tokens=False)):
        assert own(text) == np.asarray(ids.ids, "<u4").tobytes()


def test_naive_bayes_against_counting(spark):
    """With enough buckets that no two n-grams here share one, against plain dictionaries."""
    taught = [(1, "the cat sat on the mat", "en"), (2, "le chat est sur le tapis", "fr"), (3, "a dog", "en"), (4, "un chien noir", "fr"), (5, None, "fr"), (6, "x", None)]
    model = language_id.fit(spark.createDataFrame(taught, "doc_id long, text string, lang string"), bits=22, order=3, alpha=0.5)
    grams = lambda t: [t.lower()[i : i + n] for n in (1, 2, 3) for i in range(len(t)) if i + n <= len(t)]
    texts = ["the dog", "le chien", "cat", "chat noir", "zzz"]
    got = {r["doc_id"]: r for r in language_id.predict(docs(spark, list(enumerate(texts))), model).collect()}
    for i, text in enumerate(texts):
        logs = {}
        for lang in ("en", "fr"):
            own = [t for _, t, k in taught if k == lang and t]
            counts = Counter()
            for t in own:
                counts.update(padded(t))
            total = sum(counts.values()) + 0.5 * (1 << 22)
            logs[lang] = math.log(len(own) / 4) + sum(math.log((counts[g] + 0.5) / total) for g in padded(text))
        best = max(logs, key=lambda k: (logs[k], k == "en"))
        assert got[i]["lang_pred"] == best
        assert abs(got[i]["score"] - 1 / sum(math.exp(v - logs[best]) for v in logs.values())) < 1e-3
    assert grams("ab") == ["a", "b", "ab"]


def padded(text):
    """N-grams that begin in a text; the last ones reach into the separators after it."""
    low = text.lower() + "\n\n\n"
    return [low[i : i + n] for n in (1, 2, 3) for i in range(len(text))]


def test_quality_against_enumeration(spark):
    """Whole texts of few lines: marginals by summing over all labellings, weighted by length."""
    rng = np.random.default_rng(3)
    lines = ["This is a plain line of words.", "BUY!! NOW!! ###", "", "another good line, with a comma", "$$$ *** 1234"]
    texts = ["\n".join(rng.choice(lines, int(rng.integers(1, 5)))) for _ in range(12)]
    good, bad = "This is a plain sentence of words.\nAnd so is this other one.", "BUY!! NOW!! $$$ ###\nCLICK!! HERE!! ***"
    model = line_quality.fit(docs(spark, [(i, good if i % 2 else bad) for i in range(30)]), spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int"))
    got = {r["doc_id"]: r["score"] for r in line_quality.score(docs(spark, list(enumerate(texts))), model).collect()}
    import pyarrow as pa

    for i, text in enumerate(texts):
        x, chars, first = line_quality.line_features(pa.array([text]))
        e, t, n = line_quality.emissions(x, first, model.weights), model.pairs, len(x)
        total, marginal = 0.0, np.zeros(n)
        for y in np.ndindex(*(2,) * n):
            p = math.exp(sum(e[k] * y[k] for k in range(n)) + sum(t[y[k], y[k + 1]] for k in range(n - 1)))
            total, marginal = total + p, marginal + p * np.array(y)
        # a line's length counts its line end
        weight = np.maximum([len(line) for line in text.splitlines(True)] + [0] * text.endswith("\n") or [0], 1e-3)
        q = min(max((weight * marginal / total).sum() / weight.sum(), 1e-6), 1 - 1e-6)
        assert abs(got[i] - 1 / (1 + math.exp(-(model.slope * math.log(q / (1 - q)) + model.shift)))) < 1e-5


def test_junk_after_many_lines_teaches(spark):
    """2000 good lines, then as many bad ones: a prefix would call it good."""
    good, bad = "This is a plain sentence of words that goes on.", "BUY!! NOW!! $$$ ### CLICK!! HERE!! *** 12345"
    long = "\n".join([good] * 2000 + [bad] * 4000)
    rows = [(i, long if i % 2 == 0 else "\n".join([good] * 40)) for i in range(12)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    model = line_quality.fit(docs(spark, rows), labels)
    got = {r["doc_id"]: r["score"] for r in line_quality.score(docs(spark, rows), model).collect()}
    assert all((got[i] >= 0.5) == (i % 2 == 1) for i in range(12))
    # the bound takes whole documents, in the order of the hash of their ids
    assert line_quality.fit(docs(spark, rows), labels, sample_bytes=len(long) - 1) is None


def test_a_repeat_that_only_the_method_sees(spark):
    """A passage of 20 words twice among 150: 27 % of the words repeat, 13 % in one piece."""
    passage = " ".join(f"p{i}" for i in range(20))
    text = " ".join([passage, *(f"a{i}" for i in range(60)), passage, *(f"b{i}" for i in range(50))])
    several = " ".join(f"{' '.join(f'q{k}_{i}' for i in range(8))} c{k} {' '.join(f'q{k}_{i}' for i in range(8))} d{k}" for k in range(2)) + " " + " ".join(f"e{i}" for i in range(120))
    got = {r["doc_id"]: r for r in quality_rules.judge(quality_rules.measure(docs(spark, [(1, text), (2, several), (None, text), (1, text)]))).collect()}
    assert (got[1]["n_repeat_words"], got[1]["longest_repeat"], got[1]["base_failed"], got[1]["kept"]) == (40, 20, False, False)
    assert (got[2]["n_repeat_words"], got[2]["base_failed"], got[2]["kept"]) == (32, False, True) and got[None]["kept"] is False


def test_very_long_texts(spark):
    """A text of 120,000 words, twice, and beside short ones."""
    rows = [(1, LONG), (2, LONG), (3, "short"), (4, None)]
    df = docs(spark, rows)
    out = {r["doc_id"]: r for r in substring_dedup.removed(df, substring_dedup.repeated_runs(df)).collect()}
    assert (out[1]["n_removed"], out[2]["n_removed"], out[2]["longest_repeat"]) == (0, 120_000, 120_000)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.classes(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    pieces = packing.best_fit(df, tokenizer_path()).collect()
    for d in (1, 2):
        own = sorted((r["start"], r["length"]) for r in pieces if r["doc_id"] == d)
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and all(n == 2048 for _, n in own[1:])
    measured = {r["doc_id"]: r for r in quality_rules.measure(df).collect()}
    assert measured[1]["n_words"] == 120_000 and measured[1]["n_repeat_words"] == 0
    scanned = {r["doc_id"]: r["labels"] for r in license_scan.scan(docs(spark, [(1, LONG + "\nReleased under the MIT License.\n" + LONG), (None, "Released under the MIT License."), (None, "plain")])).collect() if r["doc_id"]}
    assert scanned == {1: "mit"}


def test_rows_without_an_id_keep_their_labels(spark):
    got = license_scan.scan(docs(spark, [(None, "Licensed under CC BY-NC 4.0."), (None, "plain"), (7, "Licensed under CC BY-NC 4.0."), (7, "Licensed under CC BY-NC 4.0.")]).withColumn("word", F.lit("clash")).withColumn("size", F.lit(1))).collect()
    assert sorted((str(r["doc_id"]), r["labels"]) for r in got) == [("7", "cc"), ("7", "cc"), ("None", ""), ("None", "cc")]
