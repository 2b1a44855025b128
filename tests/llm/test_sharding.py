import random
import zlib

import pytest
from cases import empty

from tessella.llm import sharding


def smallest(sizes, shards):
    def fits(c):
        n, now = 1, 0
        for x in sizes:
            if x > c:
                return False
            if now + x > c:
                n, now = n + 1, 0
            now += x
        return n <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        m = (low + high) // 2
        low, high = (low, m) if fits(m) else (m + 1, high)
    return low


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_minimax(monkeypatch, seed):
    rnd = random.Random(seed)
    span = (-(2**63), 2**63) if seed % 3 else (5, 50_000)
    sizes = {rnd.randrange(*span): rnd.choice([1, 7, 100, 10_000 if seed % 2 else 8]) for _ in range(rnd.choice([1, 3, 20, 4000]))}

    def histogram(keys, spans, bits):
        out = {}
        assert len(spans) <= 16
        for k, s in sizes.items():
            if any(a <= k <= b for a, b in spans):
                a, b, t = out.get(k >> (64 - bits), (k, k, 0))
                out[k >> (64 - bits)] = (min(a, k), max(b, k), t + s)
        return sorted(out.values())

    monkeypatch.setattr(sharding, "_histogram", histogram)
    capacity, cuts = sharding.plan_cuts(None, 16)
    assert capacity == smallest([s for _, s in sorted(sizes.items())], 16)
    got = [0] * 16
    for k, s in sizes.items():
        got[sum(k > c for c in cuts)] += s
    assert max(got) <= capacity


def test_contract(spark, docs):
    got = sharding.shard(docs).collect()
    assert len(got) == docs.count()
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == want
    by_text, slots = {}, {}
    for r in got:
        assert by_text.setdefault((r["text_crc32"], r["size"]), r["shard"]) == r["shard"] and r["law"] == "bytes" and r["grown_shard"] is None
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(empty(spark)).count() == 0
