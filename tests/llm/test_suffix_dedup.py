import random

import numpy as np
import pytest
from cases import empty, frame

from tessella.llm import suffix_dedup as sd


def brute(rows, length):
    """doc_id -> (n_bytes, n_removed, n_spans, kept); rows in order of doc_id, each id once."""
    seen, out = set(), {}
    for i, t in rows:
        raw = (t or "").encode()
        hit = np.zeros(len(raw) + 1, int)
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                hit[p] += 1
                hit[p + length] -= 1
            seen.add(w)
        gone = np.cumsum(hit)[: len(raw)] > 0
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(raw) else 0
        out[i] = (len(raw), int(gone.sum()), runs, bytes(np.frombuffer(raw, np.uint8)[~gone]))
    return out


def check(df, length=sd.LENGTH):
    rows = sorted({(r["doc_id"], r["text"]) for r in df.collect()}, key=lambda r: (r[0] is not None, r[0]))
    want = brute(rows, length)
    got = sd.remove_repeats(df, length).collect()
    assert len(got) == df.count()
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[r["doc_id"]], r["doc_id"]
    return sum(r["n_removed"] for r in got)


def test_awkward_rows(spark, docs):
    assert check(docs.where("doc_id is not null")) > 1000
    assert sd.remove_repeats(empty(spark)).count() == 0


def test_null_id_is_first(spark):
    rows = [(None, "y" * 30 + "abc" * 60, None, None, None, 0.0, 0, 0, ""), (1, "abc" * 60, None, None, None, 0.0, 0, 0, "")]
    got = {r["doc_id"]: r["n_removed"] for r in sd.remove_repeats(frame(spark, rows)).collect()}
    assert got[1] == 180 and got[None] > 0


@pytest.mark.parametrize("seed, contexts", [(0, 4000), (1, 4000), (2, 4000), (0, 3), (1, 2), (2, 1)])
def test_random_edits(spark, seed, contexts, monkeypatch):
    """Many texts over few letters, with shared and edited passages, so that edges of passages differ; small batches make the levels merge, and few contexts a family make several families."""
    monkeypatch.setattr(sd, "BATCH_WINDOWS", 200)
    monkeypatch.setattr(sd, "FAMILY_CONTEXTS", contexts)
    rnd = random.Random(seed)
    letters = "ab" if seed == 0 else "abcdefgh"
    pool = ["".join(rnd.choice(letters) for _ in range(rnd.randint(60, 400))) for _ in range(6)]
    rows = []
    for i in range(80):
        t = "".join(rnd.choice(pool)[rnd.randint(0, 40) :] for _ in range(rnd.randint(1, 4)))
        t = list(t)
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(len(t))] = rnd.choice(letters + "é")
        rows.append((i, "".join(t), None, None, None, 0.0, 0, 0, ""))
    assert check(frame(spark, rows)) > 0


def test_family_levels(monkeypatch):
    monkeypatch.setattr(sd, "SLICE", 7)
    rnd = random.Random(0)
    family, seen, pool = sd.SuffixFamily(6), set(), []
    for _ in range(40):
        batch = [bytes(rnd.choice(b"ab\0") for _ in range(rnd.randint(6, 12))) for _ in range(rnd.randint(1, 20))]
        batch += rnd.sample(pool, min(5, len(pool))) + [x[1:] for x in rnd.sample(pool, min(3, len(pool))) if len(x) > 6]
        pool += batch
        monkeypatch.setattr(sd, "BATCH_WINDOWS", rnd.randint(1, 50))
        got = family.add(np.frombuffer(b"".join(batch), np.uint8), np.array([len(x) for x in batch]))
        windows = [x[k : k + 6] for x in batch for k in range(len(x) - 5)]
        assert len(got) == len(windows)
        for w, g in zip(windows, got, strict=True):
            assert g == (w in seen)
            seen.add(w)
        sizes = [len(x) for x in family.levels]
        assert sum(sizes) == len(seen) and all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
        for level in family.levels:  # sorted by the bytes at their places
            text = [family.text[p : p + 6].tobytes() for p in level]
            assert text == sorted(set(text))


def test_levels_decide(spark, monkeypatch):
    """Every removed byte is one of a window that a suffix array found: most windows meet an earlier level, with families that live across grams."""
    monkeypatch.setattr(sd, "BATCH_WINDOWS", 2000)
    rnd = random.Random(3)
    letters = "abcdefgh "
    pool = ["".join(rnd.choice(letters) for _ in range(300)) for _ in range(60)]
    rows = [f"{i} ".encode() + "".join(rnd.choice(letters) for _ in range(50)).encode() + rnd.choice(pool).encode() for i in range(400)]
    family, anchors, met, total = sd.SuffixFamily(), sd.Anchors(), 0, 0
    for k in range(0, 400, 10):
        gram, _, start, end = anchors.contexts(rows[k : k + 10])
        data = b"".join(rows[k : k + 10])
        met += (len(family.levels) > 0) * int((end - start - 99).sum())
        total += int((end - start - 99).sum())
        family.add(np.frombuffer(b"".join(data[a:b] for a, b in zip(start, end, strict=True)), np.uint8), end - start)
        assert len(set(gram.tolist())) > 50
    assert met > 0.9 * total and len(family.levels) <= np.log2(total)


def test_least():
    rnd = np.random.default_rng(0)
    for n, w in ((10, 3), (77, 77), (500, 77), (154, 77)):
        x = rnd.integers(0, 50, n).astype(np.uint64)
        assert (sd._least(x, w) == [x[i : i + w].min() for i in range(n - w + 1)]).all()


def test_segments_of_long_texts(spark, monkeypatch):
    """Chunks smaller than texts: windows across seams, in repeats inside a text and between texts, and repeated rows."""
    monkeypatch.setattr(sd, "CHUNK_BYTES", 333)
    rnd = random.Random(9)
    passage = "".join(rnd.choice("abcdef") for _ in range(900))
    noise = lambda n: "".join(rnd.choice("ghijklé") for _ in range(n))
    texts = [noise(500) + passage + noise(77) + passage[100:800], noise(10) + passage[5:], passage, noise(2000), passage[:99], passage[:100], "x" * 1500]
    rows = [(i, t, None, None, None, 0.0, 0, 0, "") for i, t in enumerate(texts)]
    assert check(frame(spark, rows + rows[:3] + rows[6:])) > 3000


def test_text_over_16_mib(spark):
    """A passage that stands twice beyond byte 2 ** 24, and once in a text of its own."""
    rnd = np.random.default_rng(2)
    passage = rnd.integers(97, 123, 400, dtype=np.uint8).tobytes().decode()
    before = rnd.integers(97, 123, 2**24 + 2000, dtype=np.uint8).tobytes().decode()
    rows = [(1, before + passage + "0" * 50 + passage, None, None, None, 0.0, 0, 0, ""), (2, "1" + passage, None, None, None, 0.0, 0, 0, "")]
    got = {r["doc_id"]: r for r in sd.remove_repeats(frame(spark, rows)).collect()}
    assert got[1]["n_removed"] == 400 and bytes(got[1]["kept"]) == (before + passage + "0" * 50).encode()
    assert got[2]["n_removed"] == 400 and bytes(got[2]["kept"]) == b"1"


def test_least_long_as_id(spark):
    rows = [(-(2**63), "abc" * 60, None, None, None, 0.0, 0, 0, ""), (3, "abc" * 60, None, None, None, 0.0, 0, 0, "")]
    got = {r["doc_id"]: r["n_removed"] for r in sd.remove_repeats(frame(spark, rows)).collect()}
    assert set(got) == {-(2**63), 3} and got[3] == 180


def test_merged_ranges():
    rnd = np.random.default_rng(4)
    for n in (0, 1, 5, 200):
        row, start = rnd.integers(0, 6, n), rnd.integers(0, 300, n)
        stop = start + rnd.integers(1, 40, n)
        want = []
        for r in range(6):
            spans = sorted((a, b) for a, b in zip(start[row == r].tolist(), stop[row == r].tolist(), strict=True))
            out: list[list[int]] = []
            for a, b in spans:
                if out and a <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], b)
                else:
                    out.append([a, b])
            want += [(r, a, b) for a, b in out]
        assert list(zip(*(x.tolist() for x in sd._merged_ranges(row, start, stop)), strict=True)) == want


def test_texts_that_share_an_id(spark):
    """What is removed from one text of an id is removed at the same place of its others, as far as they reach."""
    rnd = random.Random(1)
    passage = "".join(rnd.choice("abcdefgh") for _ in range(300))
    rows = [(1, passage, None, None, None, 0.0, 0, 0, ""), (2, "x" * 50 + passage, None, None, None, 0.0, 0, 0, ""), (2, "y" * 20, None, None, None, 0.0, 0, 0, ""), (2, "z" * 70, None, None, None, 0.0, 0, 0, "")]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]).decode()) for r in sd.remove_repeats(frame(spark, rows)).collect())
    assert got == [(1, 300, 0, 0, passage), (2, 20, 0, 0, "y" * 20), (2, 70, 20, 1, "z" * 50), (2, 350, 300, 1, "x" * 50)]
