"""Quality classifier by compression.

One zstandard dictionary is trained on texts labelled good and one on texts labelled bad, both for the same size (zstandard may leave out a little that pays for nothing). A text is compressed with either; the difference of the sizes,
divided by the text's own size, says which texts it resembles. A logistic curve through the differences of the labelled texts that went into neither dictionary makes a probability of it.

The fit uses a bounded sample of the labelled rows: each label's rows are thinned by a hash of the id to ``TRAIN_ROWS`` expected rows, half of them for the dictionaries and half for
the curve. The dictionaries are trained on whole texts, in pieces; the curve is fitted on whole texts too, which stay on the executors. Scoring is a map over whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, sliced, staged

#: Expected rows of each label in the sample.
TRAIN_ROWS = 3000
#: Expected bytes of the texts of one label that a dictionary is trained on at most. Where the sampled texts are longer, fewer rows go in, at one rate for both labels; no text is cut.
TRAIN_BYTES = 1 << 24
#: Bytes of a dictionary, and of the pieces of texts that it is trained on.
DICT_BYTES, PIECE = 1 << 18, 1024
#: Bytes of the segments that a dictionary is put together from, and of the strings that are counted to choose them.
SEGMENT, COUNTED = 200, 8
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    prior: float


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.good, self.bad = (zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad))

    def difference(self, text: str) -> float:
        """Bytes that the good dictionary saves against the bad one, for each byte of the text."""
        raw = text.encode()
        good, bad = len(self.good.compress(raw)), len(self.bad.compress(raw))
        return (bad - good) / len(raw)

    def score(self, text: str | None) -> float:
        if not text:
            return self.model.prior
        return _logistic(self.model.slope * self.difference(text) + self.model.offset)


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    made = zstandard.ZstdCompressionDict(raw)
    made.precompute_compress(level=LEVEL)
    return made


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _dictionaries(good: list[str], bad: list[str]) -> tuple[bytes, bytes]:
    """Dictionaries trained for one size, a quarter of the smaller label's texts at most. Labels with too little text to train on give their texts as they are."""
    raws = [[t.encode() for t in texts] for texts in (good, bad)]
    size = min(DICT_BYTES, min(sum(map(len, r)) for r in raws) // 4)
    out = []
    for texts in raws:
        pieces = [t[at : at + PIECE] for t in texts for at in range(0, len(t), PIECE)]
        try:
            out.append(zstandard.train_dictionary(size, pieces, k=SEGMENT, d=COUNTED, level=LEVEL).as_bytes())
        except (zstandard.ZstdError, ValueError):
            out = [b"\n".join(r)[-DICT_BYTES:].ljust(8) for r in raws]
            break
    return out[0], out[1]


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with a small ridge."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w, g = p * (1 - p), p - y
        h = np.array([[np.sum(w * x * x) + 1e-3, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 1e-3]])
        step = np.linalg.solve(h, [np.sum(g * x) + 1e-3 * a, np.sum(g) + 1e-3 * b])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, label: 1 for good, 0 for bad).

    The labels are thinned first, and the few that stay are broadcast, so no text is shuffled. Rows with a null or an empty text are left out; of several labels of a doc_id the least counts, and
    of several texts the first in order.
    """
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("label") == 1, min(1.0, train_rows / max(1, sizes.get(1, 0)))).otherwise(min(1.0, train_rows / max(1, sizes.get(0, 0))))
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(2**30)) / 2**30
    few = labels.withColumns({"unit": unit, "share": share}).where(F.col("unit") < F.col("share"))
    texts = docs.where(F.col("text") != "").select("doc_id", "text")
    joined = texts.join(F.broadcast(few.select("doc_id", "label", "unit", "share")), "doc_id").groupBy("doc_id", "label", "unit", "share").agg(F.min("text").alias("text"))
    sample = staged(joined, "classifier-sample")
    halves = F.col("unit") < F.col("share") / 2
    bytes_of = [r["n"] for r in sample.where(halves).groupBy("label").agg(F.sum(F.octet_length("text").cast("long")).alias("n")).collect()]
    rate = min(1.0, TRAIN_BYTES / max([1, *bytes_of]))
    chosen = sorted((r["doc_id"], r["label"], r["text"]) for r in sample.where(F.col("unit") < F.col("share") / 2 * rate).select("doc_id", "label", "text").collect())
    good, bad = ([t for _, y, t in chosen if y == label] for label in (1, 0))
    prior = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
    model = Model(*_dictionaries(good, bad), 0.0, math.log(prior / (1 - prior)), prior)
    held = sorted(map(tuple, _differences(sample.where(~halves).select("doc_id", "label", "text"), model).collect())) if good and bad else []
    discard(sample)
    if {y for _, y, _ in held} == {0, 1}:
        x, y = np.array([d for _, _, d in held]), np.array([float(y) for _, y, _ in held])
        model.slope, model.offset = _curve(x, y)
        # The sample has other shares of good and bad than the rows.
        taken = y.mean()
        model.offset += math.log(prior / (1 - prior)) - math.log(taken / (1 - taken))
    return model


def _differences(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, label and the difference of each text."""
    shared = rows.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*shared.value))
        for batch in sliced(batches, 500):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([scorer.difference(t) for t in batch.column(2).to_pylist()], pa.float64())], names=["doc_id", "label", "difference"])

    return map_batches(rows, run, ", ".join(f"{n} {t}" for n, t in rows.dtypes[:2]) + ", difference double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score; a column of this name is replaced. Null and empty texts get the share of good rows; equal texts are scored alike; an empty table gives an empty result."""
    docs = docs.drop("score")
    at, shared = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*shared.value))
        for batch in sliced(batches, 500):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([scorer.score(t) for t in batch.column(at).to_pylist()], pa.float64())], names=[*batch.schema.names, "score"])

    return map_batches(docs, run, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", score double")
