"""Cases that show whether an operator does its whole job."""

import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from codebrook.llm import decontamination, license_scan


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_near_duplicate_stage_against_brute_force(spark):
    """Linked from 0.8 on sets of 5 words."""
    rng = np.random.default_rng(8)
    rows = []
    for group in range(6):
        base = [f"g{group}w{i}" for i in range(300)]
        rows.append((100 * group, " ".join(base)))
        for k in range(1, 9):
            w = list(base)
            for i in rng.choice(300, 2 * k, replace=False):
                w[i] = f"edit{group}_{k}_{i}"
            rows.append((100 * group + k, " ".join(w)))
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = corpus_pipeline.near_duplicates(spark, docs(spark, rows), "")
    assert {r["doc_id"] for r in kept.collect()} == {find(d) for d in sets}


def test_part_of_a_long_item_is_a_match(spark):
    """90 of 200 words, 20 of 200, 30 of 200 with edits, 10 of 200 (too few), and shuffled words (none)."""
    rng = np.random.default_rng(4)
    item = [f"w{i}" for i in rng.integers(0, 120, 200)]
    edited = list(item[60:100])
    edited[10], edited[25] = "other", "another"
    own = lambda k: " ".join(f"own{k}_{i}" for i in range(60))
    parts = {1: item[50:140], 2: item[100:120], 3: edited, 4: item[10:20], 5: list(rng.permutation(item)), 6: []}
    rows = [(k, f"{own(k)} {' '.join(w)} {own(-k)}") for k, w in parts.items()] + [(k, own(k)) for k in range(10, 20)]
    bench = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in decontamination.matches(docs(spark, rows), bench).collect()}
    assert set(got) == {1, 2, 3} and abs(got[1] - 0.45) < 0.02
    assert {r["doc_id"] for r in decontamination.clean(docs(spark, rows), bench).collect()} == {4, 5, 6, *range(10, 20)}


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation"""


def test_wrapped_license_notices(spark):
    """Wrapped at 72 to 80 columns, at 20, and as comments; words far apart are no notice."""
    commented = lambda text, mark: "\n".join(f"{mark} {x}" for x in text.split("\n"))
    narrow = "\r\n".join(re.findall(r".{1,20}(?:\s|$)", BSD.replace("\n", " ")))
    far = "\n".join(f"{w} then come many other words that say nothing of that kind at all" for w in BSD.split())
    rows = [(1, MIT), (2, BSD), (3, GPL), (4, "def f():\n" + commented(MIT, " *")), (5, commented(BSD, "#")), (6, narrow), (7, far), (8, BSD.split("\n")[0])]
    got = {r["doc_id"]: r for r in license_scan.scan(docs(spark, rows)).collect()}
    assert [got[k]["labels"] for k in range(1, 9)] == ["mit", "bsd", "gpl", "mit", "bsd", "bsd", "", ""]
    assert [got[k]["score"] for k in range(1, 9)] == [1.0] * 6 + [0.0] * 2


def test_runs_of_words_against_brute_force(spark):
    rng = np.random.default_rng(6)
    pool = [w for _, t in license_scan.TEMPLATES for w in re.findall("[a-z0-9]+", t.lower())] + ["x", "y"]
    rows = []
    for k in range(60):
        own = re.findall("[a-z0-9]+", license_scan.TEMPLATES[k % 9][1].lower())
        w = [own[j] if rng.random() < 0.9 else str(rng.choice(pool)) for j in range(len(own))]
        w = list(rng.choice(pool, 12)) + w + list(rng.choice(pool, 12))
        rows.append((k, "\n".join(map(str, w))))
    want = {}
    for d, t in rows:
        w = t.split("\n")
        found = {}
        for k, (label, text) in enumerate(license_scan.TEMPLATES):
            own = re.findall("[a-z0-9]+", text.lower())
            length = -(-100 * len(own) // 80)
            best = max(len(set(own) & set(w[i : i + length])) for i in range(len(w)))
            if 100 * best >= 80 * len(set(own)):
                found[k] = best
        want[d] = found
    read = docs(spark, rows).select("doc_id", F.col("text").alias("low")).withColumn("w", license_scan.words(F.col("low"))).withColumn("_row", F.xxhash64("low"))
    got = {d: {} for d, _ in rows}
    for r in license_scan.block_matches(read).where("block IS NULL").collect():
        got[r["doc_id"]][r["template"]] = max(r["overlap"], got[r["doc_id"]].get(r["template"], 0))
    assert got == want and sum(map(len, want.values())) > 30


def test_first_places_over_many_slices(spark):
    """A passage that all documents share, met in many slices of a task, in any order of ids."""
    import hashlib

    from codebrook.llm import substring_dedup

    rng = np.random.default_rng(12)
    shared, rows = [f"s{i}" for i in range(30)], []
    for d in rng.permutation(120):
        own = [f"o{d}_{i}" for i in range(20)]
        rows.append((int(d), " ".join(own[:10] + shared[: 30 - d % 4] + own[10:] + (shared if d % 7 == 0 else []))))
    first = {}
    for d, t in sorted(rows):
        w = t.split()
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    table = docs(spark, rows).coalesce(1)
    got = {r["doc_id"]: r for r in substring_dedup.removed(table, substring_dedup.repeated_runs(table, slice_bytes=2000)).collect()}
    for d, t in rows:
        w = t.split()
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        assert got[d]["n_removed"] == len(gone)
        assert got[d]["kept_sha256"] == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()


def test_repeated_shingles_over_many_slices(spark):
    from codebrook.llm import ngram_join

    rows = [(d, " ".join([f"o{d}_{i}" for i in range(9)] + [f"s{i}" for i in range(12)] + [f"p{d % 5}_{i}" for i in range(8)])) for d in range(200)]
    rows += [(500, " ".join(f"z{i}" for i in range(40)))]
    counts = {}
    sets = {d: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for d, t in rows}
    for s in sets.values():
        for x in s:
            counts[x] = counts.get(x, 0) + 1
    got = {r["doc_id"]: r["repeated"] for r in ngram_join.repeated_counts(docs(spark, rows).coalesce(1), 3, 3000).collect()}
    for d, s in sets.items():
        want = sum(counts[x] > 1 for x in s)
        assert want <= got.get(d, 0) <= want + 2


def test_representatives_of_odd_rows(spark):
    from codebrook.llm import ngram_join

    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [(1, a), (2, a), (2, b), (None, b), (None, c), (None, c), (None, ""), (3, None), (3, None), (4, " \n"), (5, "a0 " + a)]
    clash = docs(spark, rows).selectExpr("*", "7 AS sig", "8 AS least", "9 AS n", "doc_id AS root")
    kept = ngram_join.representatives(clash, n=5, percent=80)
    assert kept.columns == clash.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == sorted([("1", a), ("2", b), ("None", c), ("None", ""), ("3", "None"), ("3", "None"), ("4", " \n")])
