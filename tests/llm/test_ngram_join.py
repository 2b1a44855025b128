import random

import numpy as np
import pytest
from cases import empty, frame, words
from pyspark.sql import functions as F

from tessella.llm import ngram_join as nj
from tessella.llm.components import components


def brute(rows, size, t):
    """(doc_id, n, least id reachable) of every row, by all pairs of rows."""
    sets = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if x and y and t[1] * len(x & y) >= t[0] * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return sorted(((i, len(x), least.get(find(a))) for a, (i, x) in enumerate(sets)), key=repr)


def check(df, size, t):
    got = sorted(map(tuple, nj.similar(df, size, t).collect()), key=repr)
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()], size, t)
    assert got == want
    return sum(i != c for i, _, c in got)


@pytest.mark.parametrize("size, t", [(3, (90, 100)), (5, (80, 100)), (1, (50, 100))])
def test_awkward_rows(spark, docs, size, t):
    assert check(docs, size, t) > 3


@pytest.mark.parametrize("seed", range(3))
def test_random_edits(spark, seed, monkeypatch):
    """Groups of near copies, some linked in chains only, and short sets at the edge of the threshold."""
    monkeypatch.setattr(nj, "PART_ENTRIES", [200, 2, 1][seed])
    rnd = random.Random(seed)
    rows = []
    for g in range(6):
        base = words(rnd, rnd.choice([3, 9, 12, 40, 120])).split()
        for _ in range(rnd.randint(1, 15)):
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = f"e{rnd.randrange(5)}"
            rows.append(" ".join(w + [f"g{g}"] * rnd.randint(0, 2)))
            if rnd.random() < 0.3:
                base = w
    rnd.shuffle(rows)
    df = frame(spark, [(i, t, None, None, None, 0.0, 0, 0, "") for i, t in enumerate(rows)])
    check(df, 3, (90, 100))
    check(df, 2, (80, 100))


def test_empty(spark):
    assert nj.similar(empty(spark)).count() == 0


def test_rows_without_ids_and_shared_ids(spark):
    """Two classes that have nothing in common stay apart, though each has a row without an id, and rows of one id with other texts; the least long is an id."""
    rnd = random.Random(2)
    one, two, three = (words(rnd, 60) for _ in range(3))
    rows = [(1, one), (None, one), (2, two), (None, two + " more"), (7, one), (7, two), (None, three), (None, three), (-(2**63), three + " tail"), (9, "x"), (None, ""), (-(2**63), None)]
    df = frame(spark, [(i, t, None, None, None, 0.0, 0, 0, "") for i, t in rows])
    assert check(df, 3, (90, 100)) == 6
    got = {tuple(r) for r in nj.similar(df).collect()}
    assert {(c) for i, n, c in got if i is None and n > 0} == {1, 2, -(2**63)}


def test_hubs_are_dealt_out(spark, monkeypatch):
    """One large class, whose hub meets its members in parts."""
    monkeypatch.setattr(nj, "HUB_PAIRS", 3)
    monkeypatch.setattr(nj, "PART_ENTRIES", 4)
    rnd = random.Random(4)
    base = words(rnd, 80).split()
    rows = []
    for i in range(60):
        w = list(base)
        w[rnd.randrange(len(w))] = f"e{i}"
        rows.append((i, " ".join(w), None, None, None, 0.0, 0, 0, ""))
    assert check(frame(spark, rows), 3, (90, 100)) > 50


@pytest.mark.parametrize("t", [(90, 100), (80, 100)])
def test_prefixes_are_rare_first(spark, t):
    """Places follow one order for all nodes; a node that has enough shingles alone has no entries, and the others have those of their first shingles that several nodes have."""
    rnd = random.Random(6)
    common = [f"c{i}" for i in range(40)]
    rows = [(i, " ".join([*common, *(f"u{i}x{k}" for k in range(400))])) for i in range(30)]
    rows += [(100 + i, " ".join(rnd.sample(common, 30) + [f"v{i}x{k}" for k in range(rnd.randint(0, 6))])) for i in range(40)]
    docs = spark.createDataFrame(rows, "id long, text string")
    nodes = nj.profiles(docs, 1, t).select(F.col("digest").alias("node"), "id", "n", "pool")
    sets = {nj._digest(s): set(s.tolist()) for s in map(nj.Shingler(1).shingles, (r[1] for r in rows))}
    end, count = nj._pool_end(t), lambda nodes, g: sum(g in sets[x] for x in nodes)
    last = {x: len(s) - nj._need(len(s), t) for x, s in sets.items()}
    left = [x for x, s in sets.items() if sum(g < end and count(sets, g) == 1 for g in s) <= last[x]]
    key = lambda g: (count(sets, g), 0, g) if g < end else (count(left, g), 1, g)
    want = {(x, g, i) for x in left for i, g in enumerate(sorted(sets[x], key=key)) if i <= last[x] and key(g)[0] > 1}
    assert {x for x, _, _ in want} and all(r["id"] >= 100 for r in nodes.collect() if r["node"] in left)
    held = {g for g in {g for _, g, _ in want} if sum(g == h for _, h, _ in want) > 1}
    got = {(e["node"], e["shingle"], e["i"]) for e in nj.prefixes(docs, nodes, 1, t).collect()}
    assert got == {w for w in want if w[1] in held}


def test_pool_and_bands():
    for t in ((90, 100), (80, 100), (50, 100), (99, 100)):
        rnd = np.random.default_rng(1)
        s = np.sort(rnd.integers(-(2**63), 2**63 - 1, 10_000))
        assert abs(np.searchsorted(s, nj._pool_end(t)) / 10_000 - min(1, 2 * (1 - t[0] / t[1]))) < 0.02


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(100, 101), (101, 102), (29, 200)], [(-(2**63), 5), (5, 5), (7, 5)]])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    for a, b in edges:
        x, y = want.setdefault(a, a), want.setdefault(b, b)
        want = {k: min(x, y) if v in (x, y) else v for k, v in want.items()}
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}
