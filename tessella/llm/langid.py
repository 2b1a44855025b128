"""Language ID by rank-order profiles.

A profile is the list of the most frequent letter n-grams (1 to 3 characters of a lower-cased word with a blank at either end), most frequent first. A document's
distance to a language is the sum over the document's profile of how far out of place each n-gram is in the language's; n-grams that the language lacks count as the
profile's length. The nearest language wins (ties: the first by name).

The profiles are learned from all rows that have a language, or from a bounded sample of them: each language's rows are thinned by a hash of the row to ``TRAIN_ROWS`` expected
rows. Prediction is a map over whole texts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, per_worker, sliced

PROFILE = 300
#: Expected rows of each language in a sample that profiles are learned from.
TRAIN_ROWS = 3000
#: Distinct n-grams that a task adds up before it passes their counts on, and rows that it passes on at a time.
HELD_GRAMS, OUT_ROWS = 1 << 20, 100_000
UNKNOWN = "und"
#: Characters of a text that are looked at together.
PIECE = 1 << 20
_BLANK, _BITS = np.uint64(32), np.uint64(21)


def _letters() -> np.ndarray:
    """For each code point whether it is a letter (Unicode category L)."""
    return np.fromiter(map(str.isalpha, map(chr, range(sys.maxunicode + 1))), bool, sys.maxunicode + 1)


def key_of(gram: str) -> int:
    """An n-gram of up to 3 characters as a number; numbers are ordered as the texts are."""
    return sum(ord(c) << 42 - 21 * i for i, c in enumerate(gram))


def gram_of(key: int) -> str:
    return "".join(chr(c) for c in (key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF) if c)


def _unique(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their weights (1 each if there are none)."""
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    sums = np.diff(np.append(first, len(keys))) if weights is None else np.add.reduceat(weights, first) if len(keys) else weights
    return keys[first], sums.astype(np.int64)


def count(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the text's words as numbers, in order, and how often each stands there. What isn't a letter separates words."""
    letter = per_worker("letters", _letters)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    found: list[tuple[np.ndarray, np.ndarray]] = []
    tail, inside = np.array([_BLANK]), False  # the last two characters kept, and whether the last one is a letter
    for at in range(0, len(points) + 1, PIECE):
        part = points[at : at + PIECE]
        if at + PIECE > len(points):
            part = np.append(part, np.uint32(32))  # the last word ends too
        is_letter = letter[part]
        # One blank stays after each word.
        keep = is_letter | np.concatenate([[inside], is_letter[:-1]])
        inside = bool(is_letter[-1])
        new = np.where(is_letter[keep], part[keep], np.uint32(32)).astype(np.uint64)
        old, s = len(tail), np.concatenate([tail, new])
        one = new[new != _BLANK] << np.uint64(42)
        two = (s[:-1] << np.uint64(42) | s[1:] << _BITS)[old - 1 :]
        three = (s[:-2] << np.uint64(42) | s[1:-1] << _BITS | s[2:])[max(0, old - 2) :]
        three = three[s[1:-1][max(0, old - 2) :] != _BLANK]
        found.append(_unique(np.concatenate([one, two, three])))
        tail = s[-2:]
    return found[0] if len(found) == 1 else _unique(*(np.concatenate([f[k] for f in found]) for k in (0, 1)))


def _count_rows(sums: dict[str | None, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for lang, (keys, counts) in sums.items():
        for at in range(0, len(keys), OUT_ROWS):
            grams = list(map(gram_of, keys[at : at + OUT_ROWS].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(counts[at : at + OUT_ROWS], pa.int64())], names=["lang", "gram", "n"])


def _batch_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}
    for batch in sliced(batches, 500):
        new: dict[str | None, list] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text:
                new.setdefault(lang, [sums[lang]] if lang in sums else []).append(count(text))
        for lang, parts in new.items():
            sums[lang] = _unique(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))
        if sum(len(keys) for keys, _ in sums.values()) > HELD_GRAMS:
            yield from _count_rows(sums)
            sums = {}
    yield from _count_rows(sums)


def labelled(rows: DataFrame) -> DataFrame:
    """The rows with a language and a text."""
    return rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())


def sample(rows: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """About ``train_rows`` rows (doc_id, lang, text) of each language to learn profiles from."""
    rows = labelled(rows)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, train_rows / n)).otherwise(share)
    return rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**30)) < share * 2**30).select("doc_id", "lang", "text")


def learn(rows: DataFrame, train_rows: int | None = TRAIN_ROWS, length: int = PROFILE) -> dict[str, list[str]]:
    """Profiles by language, from a sample of the rows (doc_id, lang, text) with a language, or from all of them if ``train_rows`` is None (doc_id isn't needed then).
    The driver gets ``length`` n-grams a language."""
    rows = labelled(rows) if train_rows is None else sample(rows, train_rows)
    counted = map_batches(rows.select("lang", "text"), _batch_counts, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= length)
    profiles: dict[str, list[str]] = {}
    for r in best.orderBy("lang", "rank").collect():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Profiles:
    """Distances of texts to language profiles."""

    def __init__(self, profiles: dict[str, list[str]], length: int = PROFILE) -> None:
        self.langs, self.length = sorted(profiles), length
        self.known = np.array(sorted({key_of(g) for p in profiles.values() for g in p}), np.uint64)
        self.ranks = np.full((len(self.langs), len(self.known) + 1), -1, np.int32)
        for k, lang in enumerate(self.langs):
            self.ranks[k, np.searchsorted(self.known, np.array([key_of(g) for g in profiles[lang]], np.uint64))] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        keys, counts = count(text) if text and self.langs else (np.empty(0), np.empty(0))
        if not len(keys):
            return UNKNOWN, 0.0
        n = len(self.known)
        numbers = np.minimum(np.searchsorted(self.known, keys), n - 1)
        numbers[self.known[numbers] != keys] = n
        # Most frequent first; ties: known n-grams by their text, then the others, all of which are as far from every language.
        place = numbers - counts * (n + 1)
        if len(place) > self.length:
            most = np.argpartition(place, self.length - 1)[: self.length]
            numbers, place = numbers[most], place[most]
        top = numbers[np.argsort(place, kind="stable")]
        ranks = self.ranks[:, top]
        out = np.where(ranks < 0, self.length, np.minimum(np.abs(ranks - np.arange(len(top))), self.length)).sum(axis=1)
        order = np.argsort(out, kind="stable")
        return self.langs[order[0]], float(1.0 - out[order[0]] / (self.length * len(top)))


def identify(docs: DataFrame, profiles: dict[str, list[str]], length: int = PROFILE) -> DataFrame:
    """``docs`` with lang_pred and score (1: no n-gram out of place; 0: none known), whatever the other columns hold; columns of these names are replaced.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if nothing was learned. Equal texts are judged alike; an empty table gives an empty result.
    """
    docs = docs.drop("lang_pred", "score")
    at, shared = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(profiles)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(shared.value, length)
        for batch in sliced(batches, 500):
            found = [model.predict(t) for t in batch.column(at).to_pylist()]
            langs, scores = [x[0] for x in found], [x[1] for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return map_batches(docs, predict, f"{fields}, lang_pred string, score double")
