"""The trie of conversations against one held in memory."""

import hashlib
import zlib

import numpy as np
import pytest

from codebrook.llm import prefix_trie


def plain(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out, kids = {}, {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        saved = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        leaves = sum(out[k][5] for k in below) if below else 1
        ends = ",".join(map(str, sorted(c for c in members[node] if len(paths[c]) == len(node))))
        out[node] = [min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below), leaves, saved + sum(out[k][6] for k in below), hashlib.sha256(ends.encode()).hexdigest()]
    return sorted(map(str, out.values()))


def found(spark, rows):
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(3)
    return sorted(str(list(r)) for r in prefix_trie.trie(table).collect())


def turns(conv, texts, role="user"):
    return [(conv, i, role, t) for i, t in enumerate(texts)]


def test_shared_starts_and_copies(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(60):
        rows += turns(c, [f"t{int(rng.integers(0, 2))}" for _ in range(int(rng.integers(1, 12)))])
    rows += [r for c in range(60, 90) for r in turns(c, ["hello", "same", "again é"])]
    assert found(spark, rows) == plain(rows)


def test_one_conversation_with_most_rows(spark):
    """A chain that crosses all shards, with others that leave it at many depths."""
    rows = turns(3, [f"w{i}" for i in range(300)])
    rows += [r for c in range(5, 40) for r in turns(c, [f"w{i}" for i in range(7 * (c - 4))])]
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [*turns(5, ["a", "b"]), (5, None, None, None), (5, None, "x", None), (5, 1, "user", "b"), (None, 0, "user", "a"), (7, 0, "user", "only"), (-3, 0, "user", "minus"), (11, 4, None, "é" * 50_000), *turns(10, ["a", "b"])]
    assert found(spark, rows) == plain(rows)


def test_turnless_conversations_are_members_of_the_root(spark):
    """Base absent, and no turns beyond the shared ones."""
    c = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    rows = [*turns(c, ["x"]), *turns(1000, ["y", "z"])]
    assert found(spark, rows) == plain(rows)


def test_empty(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("most", [4, 100, 10**6])
def test_queue_spills_and_keeps_its_order(most):
    rng, queue, have, out = np.random.default_rng(most), prefix_trie.SpillingQueue(most), [], []
    for step in range(400):
        for _ in range(int(rng.integers(0, 6))):
            entry = tuple(map(int, (step + rng.integers(0, 40), rng.integers(0, 5), rng.integers(0, 9), 1)))
            queue.put(entry)
            have.append(entry)
        due = sorted(e for e in have if e[:2] <= (step, 2))
        have = [e for e in have if e[:2] > (step, 2)]
        assert list(queue.upto((step, 2))) == due
        out += due
    assert bool(queue.spills) == (most == 4)


def test_small_queues_give_the_same_totals(spark):
    rows = [r for c in range(30) for r in turns(c, [f"{c % 3}", f"{c % 7}", f"{c}"])]
    tree = prefix_trie.nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    a, b = (sorted(map(tuple, prefix_trie.totals(tree, queue=q).collect()), key=str) for q in (3, 10**6))
    assert a == b
