"""Best-fit packing from a histogram of lengths.

Documents are tokenized once, into pieces of at most ``capacity`` tokens. Only the histogram of piece lengths (``capacity`` counts at most) reaches the driver, which
packs counts, longest first, each into the open sequences with the least room that fits. Sequences that are filled alike are kept as ranges of numbers, so the plan's size
follows the number of different lengths and not that of documents. Pieces then take the planned slots by their rank among those of their length; ranks are
counted in bounded parts, so a length that a third of all pieces have is no hot key.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, parallelism, per_worker, sliced, staged

CAPACITY = 4096
END_ID = 1
#: Rows ranked by one task within a length.
ROWS_PER_RANK_TASK, LEAST_RANK_ROWS = 50_000, 200
_CACHE_WORDS, _CACHE_PARTS = 100_000, 250_000
_MARK = "\x01"
#: Texts of white space, digits, letters that lower-casing and composition treat alike everywhere, and ASCII signs without the apostrophe. They fall into runs of letters, single digits and runs of signs.
_SIMPLE = re.compile(r"[ \n\t\rA-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\[-`{-~]*")
_PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on, in order."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


class Encoder:
    """Token ids of texts as little-endian 32-bit numbers.

    Simple texts are taken apart here, and new parts given to the merges alone. In other texts, as the tokenizer drops white space, the words between blanks are encoded once and remembered; the new words of a batch are
    encoded in one call.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.parts = per_worker(f"tokenizer {path}", lambda: Tokenizer.from_file(path)), {"": b""}, {}
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        # Parts may be given to the merges only if the whole tokenizer makes the same of them.
        trial = ["word", "Ünïcöde", "ßÿ", "a.b,c!!", "(x) 42", "#a_b\n1x2"]
        self.direct = all(b"".join(map(self._part, _PARTS.findall(t.lower()))) == np.array(self._encode(t), "<u4").tobytes() for t in trial)
        self.mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            letters = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
            ids = [t.id for t in self.model.tokenize(letters)]
            got = self.parts[part] = struct.pack(f"<{len(ids)}I", *ids)
        return got

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if _MARK not in w and len(w) <= 64]
        # Words in one text, a mark after each; the mark's id comes from nothing else.
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            ids = np.array(self._encode("".join(f"{w} {_MARK} " for w in some)), dtype="<u4")
            ends = np.flatnonzero(ids == self.mark[0])
            if len(self.mark) != 1 or len(ends) != len(some):
                self.known.update((w, np.array(self._encode(w), "<u4").tobytes()) for w in some)
                continue
            raw, last = ids.tobytes(), 0
            for w, end in zip(some, ends.tolist(), strict=True):
                self.known[w] = raw[4 * last : 4 * end]
                last = end + 1
        for w in words:
            if w not in self.known:
                self.known[w] = np.array(self._encode(w), "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        if len(self.known) > _CACHE_WORDS:
            self.known = {"": b""}
        if len(self.parts) > _CACHE_PARTS:
            self.parts = {}
        simple = [self.direct and _SIMPLE.fullmatch(t or "") is not None and "<|" not in (t or "") for t in texts]
        split = [None if plain else (t or "").replace("\n", " ").split(" ") for t, plain in zip(texts, simple, strict=True)]
        self._learn(list({w for ws in split if ws is not None for w in ws}.difference(self.known)))
        for t, ws in zip(texts, split, strict=True):
            if ws is not None:
                yield b"".join(map(self.known.__getitem__, ws))
                continue
            parts = _PARTS.findall((t or "").lower())
            for p in set(parts).difference(self.parts):
                self._part(p)
            yield b"".join(map(self.parts.__getitem__, parts))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of every document; a null text is an empty one, of which the end id remains."""
    kind = dict(docs.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = None, struct.pack("<I", end_id)
        for part in sliced(batches, 256):
            encoder = encoder or Encoder(tokenizer)
            keep, rows = [], []
            for k, raw in enumerate(encoder.encode(part.column(1).to_pylist())):
                raw += end
                for i, a in enumerate(range(0, len(raw), 4 * capacity)):
                    keep.append(k)
                    rows.append((i, a // 4, len(piece := raw[a : a + 4 * capacity]) // 4, zlib.crc32(piece)))
            columns = list(zip(*rows, strict=True))
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select("doc_id", "text"), cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, first sequence, pieces of the run in each sequence, offset of the first) and the number of sequences.

    Piece number j of a run stands in sequence first + j div pieces, at offset + (j mod pieces) * length.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []  # sorted rooms of open sequences
    open_: dict[int, list[tuple[int, int]]] = {}  # room: ranges (first sequence, count)
    total = 0

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            ranges = open_[room]
            if ranges and sum(ranges[-1]) == first:
                ranges[-1] = (ranges[-1][0], ranges[-1][1] + count)
            else:
                ranges.append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            else:
                room, first, count = capacity, total, -(-left // (capacity // length))
                total += count
            each = room // length
            full = min(count, left // each)
            if full:
                runs.append((length, rank, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            rest = min(left, each - 1) if full < count else 0
            if rest:
                runs.append((length, rank, first + full, rest, capacity - room))
                put(room - rest * length, first + full, 1)
                rank, left, full = rank + rest, left - rest, full + 1
            put(room, first + full, count - full)
    return runs, total


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of ``docs`` (doc_id, text).

    Equal rows are packed each by itself; a null doc_id is kept; an empty table gives an empty result; other columns are ignored.
    """
    cut = staged(pieces(docs, tokenizer, capacity, end_id), "pack-pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan(histogram, capacity)
    # No task ranks more than its share, nor more than ROWS_PER_RANK_TASK rows of a length.
    share = max(LEAST_RANK_ROWS, min(ROWS_PER_RANK_TASK, sum(histogram.values()) // parallelism(docs.sparkSession)))
    parts = max(1, -(-max(histogram.values(), default=1) // share))
    salted = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    starts = (
        salted.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    )
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(starts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("rank") - 1).drop("before", "part")
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast((table, max(histogram.values(), default=1)))
    names = [*cut.columns, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, most = shared.value
        keys = table[:, 0] * (most + 1) + table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = table[np.searchsorted(keys, length * (most + 1) + rank, side="right") - 1]
            j = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:-2]], pa.array(run[:, 2] + j // run[:, 3]), pa.array(run[:, 4] + j % run[:, 3] * length)], names=names)

    return map_batches(ranked.select(*cut.columns, "rank"), place, ", ".join(f"`{n}` {t}" for n, t in cut.dtypes) + ", sequence_id long, offset long")
