import math
import random
import zlib

import pytest
import zstandard
from cases import empty, frame, words
from pyspark.sql import functions as F

from tessella.llm import classifier
from tessella.llm.queries import op10_quality_classifier


@pytest.mark.parametrize("size, least", [("sf0.01", 0.85), ("sf0.1", 0.985)])
def test_held_out(spark, size, least):
    sf_dir = f"/root/testdata/{size}"
    got = op10_quality_classifier(spark, sf_dir).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    area = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert area > least


def test_awkward_rows(spark, docs):
    labels = docs.select("doc_id", (F.coalesce("doc_id", F.lit(0)) % 2).cast("int").alias("label"), F.lit("clash").alias("text"))
    model = classifier.fit(docs, labels)
    got = classifier.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    by_text = {}
    assert all(by_text.setdefault(r["text"], r["score"]) == r["score"] for r in got)
    assert by_text[None] == by_text[""] == model.prior
    assert classifier.score(empty(spark), model).count() == 0
    for few in (labels.where("false"), labels.where("label = 1"), labels.limit(1)):
        assert all(0 <= r["score"] <= 1 for r in classifier.score(docs, classifier.fit(docs, few)).collect())


def test_signal_beyond_the_start(spark):
    """All texts start alike; what tells the labels apart comes after 3,000 characters."""
    rnd = random.Random(3)
    start = words(rnd, 900)
    assert len(start) > 3000
    vocabulary = [[words(rnd, 4) for _ in range(60)] for _ in range(2)]
    rows = [(i, start + " " + " ".join(rnd.choice(vocabulary[i % 2]) for _ in range(40)), None, None, None, 0.0, 0, 0, "") for i in range(160)]
    df = frame(spark, rows)
    model = classifier.fit(df, df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label")))
    held = [[w.encode() in d for w in vocabulary[y]] for y, d in ((1, model.good), (0, model.bad))]
    assert all(sum(x) >= 40 for x in held) and abs(len(model.good) - len(model.bad)) < 0.1 * len(model.good)
    got = {r["doc_id"]: r["score"] for r in classifier.score(df, model).collect()}
    assert min(s for i, s in got.items() if i % 2) > max(s for i, s in got.items() if not i % 2)


def test_against_plain_python(spark):
    """Dictionaries, differences and the curve made anew from the same sample of rows."""
    rnd = random.Random(9)
    kinds = [[words(rnd, 5) for _ in range(80)] for _ in range(2)]
    rows = [(i, " ".join(rnd.choice(kinds[i % 3 > 0] if rnd.random() < 0.8 else kinds[i % 3 == 0]) for _ in range(rnd.randint(5, 60))), None, None, None, 0.0, 0, 0, "") for i in range(240)]
    df = frame(spark, rows)
    labels = df.select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("label"))
    model = classifier.fit(df, labels)
    unit = {r["doc_id"]: r["u"] for r in df.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(2**30)) / 2**30).alias("u")).collect()}
    learn, curve = [r for r in rows if unit[r[0]] < 0.5], [r for r in rows if unit[r[0]] >= 0.5]
    texts = [[r[1].encode() for r in sorted(learn) if (r[0] % 3 > 0) == y] for y in (True, False)]
    size = min(classifier.DICT_BYTES, min(sum(map(len, t)) for t in texts) // 4)
    dicts = [zstandard.train_dictionary(size, [t[i : i + classifier.PIECE] for t in ts for i in range(0, len(t), classifier.PIECE)], k=classifier.SEGMENT, d=classifier.COUNTED, level=classifier.LEVEL) for ts in texts]
    assert (model.good, model.bad) == tuple(d.as_bytes() for d in dicts)

    def packed(raw, d):
        return len(zstandard.ZstdCompressor(level=classifier.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(raw))

    def difference(text):
        raw = text.encode()
        return (packed(raw, model.bad) - packed(raw, model.good)) / len(raw)

    points = [(difference(r[1]), r[0] % 3 > 0) for r in curve]

    def loss(a, b):
        z = [(a * x + b) * (1 if y else -1) for x, y in points]
        return sum(math.log1p(math.exp(-v)) if v > -30 else -v for v in z) + 0.0005 * (a * a + b * b)

    assert model.prior == (160 + 1) / (240 + 2)
    taken = sum(y for _, y in points) / len(points)
    offset = model.offset - math.log(model.prior / (1 - model.prior)) + math.log(taken / (1 - taken))
    best = loss(model.slope, offset)
    assert all(loss(model.slope * s, offset + d) >= best - 1e-6 for s, d in ((1.01, 0), (0.99, 0), (1, 0.01), (1, -0.01)))
    for r in classifier.score(df, model).collect():
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, model.slope * difference(r["text"]) + model.offset)))))
