"""Decontamination against all-pairs alignment, and its edge cases."""

import re
import time

import numpy as np
import pytest

from codebrook.llm import decontamination as d


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower())


def smith_waterman(a, b, mismatch, gap):
    above, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (2 if x == y else -mismatch), above[j + 1] - gap, row[j] - gap))
        best, above = max(best, max(row)), row
    return best


def found(spark, rows, bench):
    return {(r["doc_id"], r["item_id"]): round(r["score"], 6) for r in d.matches(docs(spark, rows), items(spark, bench)).collect()}


def test_against_alignment_of_all_pairs(spark):
    """Items of 6 to 60 words; whole, edited, partial and shuffled copies, and none.

    A pair needs three words in a row, the seed, besides its score.
    """
    rng = np.random.default_rng(11)
    pool = [f"w{i}" for i in range(3000)]
    bench = [(k, " ".join(rng.choice(pool, int(rng.integers(6, 60))))) for k in range(25)]
    rows = []
    for k in range(150):
        own = list(rng.choice(pool, int(rng.integers(20, 80))))
        kind, item = k % 5, words(bench[k % 25][1])
        if kind == 1:
            item = [w if rng.random() > 0.12 else f"edit{k}" for w in item]
        elif kind == 2:
            item = item[: max(3, len(item) * 2 // 3)]
        elif kind == 3:
            item = list(rng.permutation(item))
        at = int(rng.integers(0, len(own)))
        rows.append((k, " ".join(own[:at] + (item if kind < 4 else []) + own[at:])))
    want = {}
    for doc, text in rows:
        for item, passage in bench:
            a, b = words(passage), words(text)
            value = smith_waterman(a, b, d.MISMATCH, d.GAP) / (2 * len(a))
            runs = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
            if not runs(a) & runs(b):
                continue
            if value >= d.SCORE or smith_waterman(a, b, d.STRICT, d.STRICT) >= 2 * d.PASSAGE:
                want[doc, item] = round(value, 6)
    assert found(spark, rows, bench) == want and len(want) > 70


def test_common_short_items_find_nothing(spark):
    plain = [(k, f"this is one of the most plain texts number{k} with words{k} of its own{k}") for k in range(200)]
    bench = [(1, "one of the most"), (2, "texts"), (3, "one of"), (4, "the capital of France is Paris and not Lyon"), (5, None), (6, ""), (7, "?!")]
    rows = [*plain, (300, "We say the capital of France is Paris and not Lyon."), (301, "Texts!"), (302, "one of"), (303, "One of the most"), (304, "most of the one")]
    assert set(found(spark, rows, bench)) == {(300, 4), (301, 2), (302, 3), (303, 1)}
    kept = {r["doc_id"] for r in d.clean(docs(spark, rows), items(spark, bench)).collect()}
    assert kept == {k for k, _ in rows} - {300, 301, 302, 303}


def test_items_copied_everywhere_are_found(spark):
    item = "which of these seven long named rivers flows through the quiet northern valley before it meets the sea at last"
    rows = [(k, f"own{k} text{k} {item} and{k} more{k}") for k in range(300)] + [(k, f"other words{k} about the quiet sea{k}") for k in range(300, 400)]
    assert set(found(spark, rows, [(9, item)])) == {(k, 9) for k in range(300)}
    # the end of the common passage stands in another item that is rare as a whole
    half = " ".join(words(item)[-6:]) + " where nine more words of another question follow right here"
    assert set(found(spark, [*rows, (500, f"a {half} b")], [(9, item), (8, half)])) == {(k, 9) for k in range(300)} | {(500, 8)}


def test_odd_rows(spark):
    item = "which of these long named rivers flows through the quiet northern valley before it meets the sea"
    rows = [(1, item), (1, item), (None, f"x {item}"), (None, "y"), (2, None), (3, ""), (4, f"{item} {item}"), (5, "z " * 200_000 + item)]
    got = sorted((r["doc_id"] or -1, r["item_id"], r["score"]) for r in d.matches(docs(spark, rows), items(spark, [(9, item), (9, item), (8, item), (None, item)]).where("item_id IS NOT NULL")).collect())
    assert got == sorted((doc, i, 1.0) for doc in (1, 1, -1, 4, 5) for i in (8, 9))
    clash = docs(spark, rows).selectExpr("*", "1 AS item_id", "'x' AS hash", "2 AS pairs", "3 AS _doc")
    kept = d.clean(clash, items(spark, [(9, item)]))
    assert kept.columns == clash.columns and sorted(str(r["text"]) for r in kept.collect()) == ["", "None", "y"]
    assert d.clean(clash.limit(0), items(spark, [(9, item)])).count() == 0 and d.clean(clash, items(spark, [])).count() == len(rows)


def test_long_items_are_linear_work(spark):
    rng = np.random.default_rng(2)
    item = [f"w{i}" for i in rng.integers(0, 5000, 20_000)]
    rows = [(1, " ".join(item[5000:9000])), (2, " ".join(item)), (3, " ".join(rng.permutation(item)))]
    began = time.time()
    got = found(spark, rows, [(9, " ".join(item))])
    assert set(got) == {(1, 9), (2, 9)} and got[2, 9] == 1.0 and abs(got[1, 9] - 0.2) < 0.01 and time.time() - began < 90


@pytest.mark.parametrize("m,n", [(3, 9), (20, 26), (7, 7)])
def test_band_is_the_whole_where_it_covers_it(m, n):
    rng = np.random.default_rng(m)
    a, b = rng.integers(0, 4, (30, m)).astype(np.uint64), rng.integers(0, 4, (30, n)).astype(np.uint64)
    best, end = d.align(a, b)
    for x, y, got, at in zip(a, b, best, end):
        assert smith_waterman(list(x), list(y), 1, 1) == got == smith_waterman(list(x), list(y[: at + 1]), 1, 1)


@pytest.mark.parametrize("size,inserted", [(1200, (250,)), (1200, (300,)), (1200, (700,)), (700, (150, 150, 150)), (129, (60,)), (400, (0,))])
def test_long_items_with_insertions_score_as_the_whole(spark, size, inserted):
    """An item cut into equal parts with foreign words between them, and once more far away."""
    rng = np.random.default_rng(size + len(inserted))
    item, own = [f"w{i}" for i in rng.integers(0, 5000, size)], [f"v{i}" for i in rng.integers(0, 5000, 3000)]
    parts, text, used = np.array_split(item, len(inserted) + 1), [], 0
    for part, n in zip(parts, (*inserted, 0)):
        text += [*part, *own[used : used + n]]
        used += n
    far = own[:2000] + item[: size // 4] + own[2000:] + text + own[:50]
    rows = [(1, " ".join(text)), (2, " ".join(far))]
    got = found(spark, rows, [(9, " ".join(item))])
    whole = smith_waterman(item, text, d.MISMATCH, d.GAP) / (2 * size)
    assert got == {(1, 9): round(whole, 6), (2, 9): round(whole, 6)}


def test_rarity_does_not_follow_the_number_of_documents(spark):
    """A seed of `rare` documents is one, of one more isn't, whatever the other documents."""
    item = "the copper kettle boils"
    for copies, others in ((20, 0), (20, 400), (21, 0), (21, 400), (21, 30_000)):
        rows = [(k, f"a{k} b{k} {item} c{k} d{k}") for k in range(copies)] + [(1000 + k, f"x{k} y{k} z{k}") for k in range(others)]
        got = {r["doc_id"] for r in d.matches(docs(spark, rows), items(spark, [(1, item)]), rare=20).collect()}
        assert got == (set(range(copies)) if copies == 20 else set())


def test_many_candidate_items_travel_in_parts(spark, monkeypatch):
    bench = [(k, f"which question number{k} asks about place{k} and about year{k} in the north{k}") for k in range(40)]
    text = " ".join(t for _, t in bench)
    monkeypatch.setattr(d, "ITEM_BYTES", 200)
    rows = [(1, text), (1, text), (2, "nothing of the kind"), (None, text)]
    got = sorted((r["doc_id"] or -1, r["item_id"], r["score"]) for r in d.matches(docs(spark, rows), items(spark, bench)).collect())
    assert got == sorted((doc, k, 1.0) for doc in (1, 1, -1) for k in range(40))
