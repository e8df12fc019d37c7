"""Ranked search against plain scoring of every document for every item."""

import math
import re
from collections import Counter

import numpy as np

from codebrook.llm import lexical_search

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, best=10):
    own = [(d, Counter(terms(t))) for d, t in docs]
    own = [(d, c) for d, c in own if c]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    out = []
    for item, text in sorted({(i, t) for i, t in items if t is not None}, key=str):
        scores = []
        for d, c in own:
            m, score = 10 + (90 * sum(c.values()) * n_docs) // n_terms, 0
            for t in set(terms(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in x for _, x in own) + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, rank + 1, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(scores)[:best])]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, score long").repartition(3)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    return sorted((tuple(r) for r in lexical_search.search(d, b, **options).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(seed=5, n=400):
    rng = np.random.default_rng(seed)
    word = lambda: f"t{int(rng.zipf(1.3)) % 300}"
    docs = [(i, " ".join(word() for _ in range(int(rng.integers(1, 60))))) for i in range(n)]
    items = [(i, " ".join(word() for _ in range(int(rng.integers(1, 90))))) for i in range(12)]
    return docs, items


def test_against_plain_scoring(spark):
    docs, items = corpus()
    assert found(spark, docs, items) == plain(docs, items)


def test_blocks_of_items_give_the_same(spark):
    docs, items = corpus(6)
    assert found(spark, docs, items, block_bytes=1500) == plain(docs, items)


def test_odd_rows(spark):
    docs = [(1, "Apple apple É_é\x00pear"), (1, "apple"), (None, "apple"), (3, None), (4, ""), (5, "-- !!"), (6, "éÉ 42"), *[(10 + i, "same words here") for i in range(30)], (99, "apple " * 5000)]
    items = [(0, "APPLE, pear!"), (0, "APPLE, pear!"), (0, "here"), (2, None), (3, "..."), (4, "nowhere"), (None, "42 éÉ É")]
    assert found(spark, docs, items) == plain(docs, items)


def test_empty_tables(spark):
    docs, items = corpus(7, 20)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []


def test_masks_that_cannot_enter_are_not_scored():
    """Ten documents hold both terms; the many with the frequent one alone stay behind their bound."""
    from codebrook.llm.lexical_search import Postings, Ranking, rank_slice

    docs, terms_ = np.repeat(np.arange(100), [2] * 10 + [1] * 90), np.array([0, 1] * 10 + [0] * 90)
    p = Postings(np.arange(100), np.zeros(100, bool), np.full(100, 5), docs, terms_, np.ones(110, np.int64))
    ranking = Ranking(1)
    put = []
    ranking.put = lambda q, s, d, own=ranking.put: (put.append(d), own(q, s, d))
    rank_slice(p, [np.array([0, 1])], np.array([10, 500]), 100, 500, ranking)
    assert sorted(put) == list(range(10))
