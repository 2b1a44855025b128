import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import empty
from tokenizers import Tokenizer

from tessella.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_places(rows, capacity):
    by = {}
    for seq, offset, length in rows:
        by.setdefault(seq, []).append((offset, length))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def place(lengths, capacity):
    runs, total = packing.plan({n: lengths.count(n) for n in set(lengths)}, capacity)
    out = []
    for length, rank, first, each, offset in runs:
        ends = [r[1] for r in runs if r[0] == length and r[1] > rank]
        n = (min(ends) if ends else lengths.count(length)) - rank
        out += [(first + j // each, offset + j % each * length, length) for j in range(n)]
    assert sorted(x[2] for x in out) == sorted(lengths)
    return check_places(out, capacity), total


@pytest.mark.parametrize("seed", range(15))
def test_plan(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 64, 4096])
    lengths = [min(capacity, max(1, int(rnd.expovariate(3 / capacity)))) if seed % 2 else rnd.randint(1, capacity) for _ in range(rnd.randint(1, 400))]
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, b in enumerate(bins) if b >= n]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    used, total = place(lengths, capacity)
    assert used == total == len(bins)


def test_round_trip(spark, docs):
    t = Tokenizer.from_file(PATH)
    got = packing.pack(docs, PATH, capacity=256).collect()
    want = []
    for r in docs.collect():
        ids = np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(r["doc_id"], k // 256, k, len(p := ids[k : k + 256]), zlib.crc32(p.tobytes())) for k in range(0, len(ids), 256)]
    assert sorted(map(repr, ((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got))) == sorted(map(repr, want))
    n = check_places([(r["sequence_id"], r["offset"], r["length"]) for r in got], 256)
    assert n <= 1.05 * sum(r["length"] for r in got) / 256 + 1
    assert packing.pack(empty(spark), PATH).count() == 0


def test_encoder_cache():
    t, e = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    texts = ["plain Words, ÀÉß (x)!! #a_b <|endoftext|> a<|b ÿµª x.y;z ×÷ ŒŸ", "It's 12\u00a0o'clock  \u0001 x\u0001y \u2028 e\u0301 E\u0301\n\n\tÀ", "\u0001", "w" * 200 + " " + "w" * 60, " lead", "trail ", "don't don't 's", "🙂🙂 a🙂b", "\u0301 a\u0301"]
    for _ in range(2):
        for text, raw in zip(texts, e.encode(texts), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text
