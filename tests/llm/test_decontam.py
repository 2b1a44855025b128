import hashlib
import random
import re

from cases import documents, empty, frame

from tessella.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(rows, items, size=13):
    keys = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            keys.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for n in {len(k) for k in keys}:
            for k in range(len(w) - n + 1):
                if who := keys.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= who
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def items():
    rows = documents()
    passage = next(r[1] for r in rows if r[0] == -5)
    w = passage.split()
    texts = [passage, " ".join(w[3:9]), " ".join(w[10:30]).upper() + "!", "a", None, "", "É É", " ".join(w[:13]), " ".join(w[:13]), "the and of", "ab " * 20, "no such words here at all but many many many more of them"]
    return [(k, t) for k, t in enumerate(texts)] + [(100, passage), (None, passage)]


def test_against_plain_python(spark, docs):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    got = sorted(map(tuple, decontam.contamination(docs, bench).collect()), key=repr)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [x for x in items() if x[0] is not None])
    assert got == sorted(want, key=repr)
    assert sum(x[5] for x in got) > 5


def test_empty_tables(spark, docs):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    assert decontam.contamination(empty(spark), bench).count() == 0
    none = decontam.contamination(docs, bench.where("false"))
    assert none.where("n_hit > 0 or contaminated").count() == 0 and none.count() == docs.count()


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    rows = [(1, "x alpha beta y gamma z delta"), (2, "delta gamma beta alpha"), (3, "alpha beta gamma " + "q " * 30 + "delta"), (4, "alpha alpha gamma delta")]
    df = frame(spark, [(i, t, None, None, None, 0.0, 0, 0, "") for i, t in rows])
    got = {r["doc"] for r in decontam.proximity_matches(df, bench, slop=3).collect()}
    assert got == {1, 2}
    assert {r["doc"] for r in decontam.exact_matches(df, bench).collect()} == set()


def brute_near(rows, items, size=13, slop=decontam.SLOP):
    """(doc, number of items with a proximity match) by all stretches of all texts."""
    from collections import Counter

    windows = [(i, w[k : k + size]) for i, t in items if i is not None and (w := split(t)) for k in range(max(1, len(w) - size + 1))]
    out = []
    for i, t in rows:
        w, found = split(t), set()
        for item, terms in windows:
            n, want = len(terms) + slop, Counter(terms)
            if item not in found and set(terms) <= set(w) and any(not want - Counter(w[k : k + n]) for k in range(max(1, len(w) - n + 1))):
                found.add(item)
        out.append((i, len(found)))
    return out


def test_proximity_against_plain_python(spark, monkeypatch):
    """Items with words put in, left out and swapped, in texts of few words, and across the pieces of a text."""
    monkeypatch.setattr(decontam, "PIECE", 32)
    rnd = random.Random(10)
    vocabulary = [f"w{i}" for i in range(60)]
    bench = [(i, " ".join(rnd.choice(vocabulary) for _ in range(n))) for i, n in enumerate([20, 14, 13, 6, 2, 1, 30])] + [(7, "w1 w1 w2"), (8, None), (9, "absent w1"), (None, "w3 w4")]
    rows = []
    for k in range(60):
        w = [rnd.choice(vocabulary + [f"u{rnd.randint(0, 200)}"] * 60) for _ in range(rnd.randint(0, 90))]
        passage = split(bench[rnd.randrange(7)][1])
        for _ in range(rnd.randint(0, 7)):
            passage.insert(rnd.randrange(len(passage) + 1), "zz")
        if rnd.random() < 0.4:
            rnd.shuffle(passage)
        rows.append((k, " ".join(w[:40] + passage + w[40:]), None, None, None, 0.0, 0, 0, ""))
    rows += [(100, None, None, None, None, 0.0, 0, 0, ""), (None, bench[0][1], None, None, None, 0.0, 0, 0, "")]
    df, table = frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_near"]) for r in decontam.contamination(df, table, slop=decontam.SLOP).collect()), key=repr)
    assert got == sorted(brute_near([r[:2] for r in rows], bench), key=repr)
    exact = {r["doc_id"]: r["n_items"] for r in decontam.contamination(df, table).collect()}
    assert sum(n > exact[i] for i, n in got) > 10 and all(n >= exact[i] for i, n in got)


def test_texts_that_share_an_item(spark):
    """Item ids repeat with other texts: one with words that the corpus lacks, one whose words are rarer, and one whose windows are cut alike."""
    rnd = random.Random(4)
    many = [" ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rnd.randint(0, 9)) for _ in range(20)) for _ in range(5)]
    bench = [(0, many[0]), (0, "words that no document of the corpus has at all anywhere in it or near"), (1, many[1]), (1, many[2]), (1, many[2]), (2, many[3]), (2, many[3] + " more")]
    rows = [(i, "head " + t + " tail", None, None, None, 0.0, 0, 0, "") for i, t in enumerate([*many, many[0] + " " + many[1], many[2] + " " + many[1]])]
    got = decontam.contamination(frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute([r[:2] for r in rows], bench))
    assert sum(r["contaminated"] for r in got) == 6


def test_null_items(spark):
    """Texts of benchmark rows without an id are hit, and are not counted as items."""
    rnd = random.Random(6)
    one, two = (" ".join(f"{rnd.choice('uvwxyz')}{rnd.randint(0, 99)}" for _ in range(16)) for _ in range(2))
    bench = [(None, one), (7, two), (None, "q r s")]
    rows = [(i, t, None, None, None, 0.0, 0, 0, "") for i, t in enumerate([one, two, one + " " + two, "p q r s t", "q r"])]
    got = sorted(map(tuple, decontam.contamination(frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string")).collect()))
    want = sorted(brute([r[:2] for r in rows], [(-1 if i is None else i, t) for i, t in bench]))
    assert [(g[:3], g[5]) for g in got] == [(w[:3], w[5]) for w in want] and [g[5] for g in got] == [True, True, True, True, False]
    assert [g[3] for g in got] == [0, 1, 1, 0, 0] and [g[4] for g in got] == [hashlib.sha256(s).hexdigest() for s in (b"", b"7", b"7", b"", b"")]


def test_long_text_with_short_items(spark, monkeypatch):
    """Work is linear in words and candidates: a text of 200,000 equal words, an item of one word and one of many equal ones; and seams between pieces of a text."""
    bench = [(1, "ab"), (2, "ab " * 500), (3, "cd"), (4, " ".join(f"w{i}" for i in range(30)))]
    rows = [(1, "ab " * 200_000, None, None, None, 0.0, 0, 0, ""), (2, "x " * 4090 + bench[3][1] + " x" * 4050 + " " + bench[3][1] + " cd", None, None, None, 0.0, 0, 0, ""), (3, "x y", None, None, None, 0.0, 0, 0, "")]
    got = sorted(map(tuple, decontam.contamination(frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string")).collect()))
    assert got == brute([r[:2] for r in rows], bench)
    assert [r[2] for r in got] == [200_000, 61, 0]


def test_shuffled_tables(spark, docs, monkeypatch):
    """Where nothing is small enough to be broadcast, and with pieces of few words."""
    monkeypatch.setattr(decontam, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontam, "MAX_BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(decontam, "PIECE", 16)
    bench = spark.createDataFrame(items(), "item_id long, text string")
    got = sorted(map(tuple, decontam.contamination(docs, bench).collect()), key=repr)
    assert got == sorted(brute([(r["doc_id"], r["text"]) for r in docs.collect()], [x for x in items() if x[0] is not None]), key=repr)
