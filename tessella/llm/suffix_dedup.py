"""Removal of long repeated byte strings with logarithmic families of suffix arrays.

A window is a string of ``length`` bytes. Windows are dealt out so that equal ones meet: a window's anchor is the place in it where the hash of a short gram is least; equal windows have equal anchors at the same
distance, and neighbours mostly share theirs. The windows of one anchor are a *context*, some 26 windows in 130 bytes.

1. Each task indexes its documents in chunks. Contexts whose gram stands in a chunk more than once go through a family of the chunk, and those of which every window has started earlier leave it as ranges to remove, so
   that a passage in many copies leaves a chunk once.
2. Grams only choose what is indexed: a context whose gram stands nowhere else holds no repeated window. For each task at most two contexts of a gram that repeats in its chunks are asked for by gram; more than two
   are known to be shared, so a very frequent gram is no hot key.
3. The other contexts are dealt out by gram to ``SuffixFamily``s, each of which has all contexts of very many grams, in the order of the documents: a batch's windows are sorted into a suffix array, which is merge-scanned against
   the levels for windows that match in all their bytes, and levels of like size are merged, so that there are logarithmically many. First windows of contexts go first: where such a match extends to the whole
   context, its other windows need not be sorted. A gram with very many contexts is dealt out to several families; a window that is
   the first in more than one of them is settled by an aggregation over 128-bit BLAKE2 digests of windows.
4. The ranges that are removed meet their documents again.

Every removal within a family is decided by comparing bytes. Memory: a chunk, or one family of about ``FAMILY_WINDOWS`` windows (their text and 8 bytes each) with one batch of windows as strings.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, Scratch, id_filter, map_batches, parallelism, picked, sliced, staged

LENGTH = 100
GRAM = 24
#: Bytes of text that a task indexes at a time; longer texts are indexed in overlapping segments.
CHUNK_BYTES = 1_000_000
#: Windows of a batch, and those that a family is planned for; the number of families follows the corpus.
BATCH_WINDOWS, FAMILY_WINDOWS = 200_000, 1_000_000
#: Windows of a level that are strings at a time.
SLICE = 1 << 16
_PLACE = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 2**64))])
    return out[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _least(keys: np.ndarray, w: int) -> np.ndarray:
    """Least of every w neighbours, from block-wise running minima in both directions."""
    n = len(keys) - w + 1
    full = np.full(-(-len(keys) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(keys)] = keys
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


class SuffixFamily:
    """Suffix arrays of windows over one text, in levels whose sizes grow geometrically. An array holds places; a window stands in one level only. The text is made of the contexts that brought a new window."""

    def __init__(self, length: int = LENGTH) -> None:
        self.length, self.text, self.used = length, np.zeros(1 << 16, np.uint8), 0
        self.levels: list[np.ndarray] = []
        self.ends: list[np.ndarray] = [np.zeros(1, np.int64)]  # of the contexts in the text, by batch

    def strings(self, places: np.ndarray, text: np.ndarray | None = None) -> np.ndarray:
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.text if text is None else text, self.length)[places]).view(f"S{self.length}").ravel()

    def add(self, contexts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Index a batch of contexts (their bytes, one after the other); for each of their windows whether it stands in an earlier batch, or earlier in this one."""
        rest = ~self._whole(contexts, sizes)
        inside = np.repeat(rest, sizes - self.length + 1)
        seen = ~inside
        if rest.any():
            places = self.used + _window_places(sizes[rest], self.length)
            self._append(contexts[np.repeat(rest, sizes)])
            self.ends.append(self.ends[-1][-1] + np.cumsum(sizes[rest]))
            seen[inside] = self._add(places)
        return seen

    def _whole(self, contexts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each context whether all of it stands in the text, or in an earlier context of this batch, at a place where its first window does: the match of the first windows is extended."""
        starts, most = np.cumsum(sizes) - sizes, int(sizes.max())
        padded = np.concatenate([contexts, np.zeros(most, np.uint8)])
        order, first, distinct = _ranked(self.strings(starts, padded))
        group = np.empty(len(sizes), np.int64)
        group[order] = np.cumsum(first) - 1
        place, leader = self._places(distinct)[group], order[first][group]
        self._reserve(most)
        ends, found = np.concatenate(self.ends), np.zeros(len(sizes), bool)
        tries = np.flatnonzero(place >= 0)
        tries = tries[ends[np.searchsorted(ends, place[tries], side="right")] >= place[tries] + sizes[tries]]
        found[tries] = _same(self.text, place[tries], padded, starts[tries], sizes[tries])
        tries = np.flatnonzero(~found & (leader < np.arange(len(sizes))) & (sizes[leader] >= sizes))
        found[tries] = _same(padded, starts[leader[tries]], padded, starts[tries], sizes[tries])
        return found

    def _places(self, ranked: np.ndarray) -> np.ndarray:
        """Where each of these windows (sorted, distinct) stands in the text, or -1."""
        out = np.full(len(ranked), -1)
        for level in self.levels:
            for mine, theirs in self._side_by_side(level, ranked):
                there, here = self._common(level[theirs], ranked[mine])
                out[mine.start + here] = level[theirs][there]
        return out

    def _add(self, places: np.ndarray) -> np.ndarray:
        order, first, ranked = _ranked(self.strings(places))
        array, known = places[order[first]], self._places(ranked) >= 0
        seen = np.empty(len(places), bool)
        seen[order] = ~first | known[np.cumsum(first) - 1]
        self._push(array[~known])
        return seen

    def _reserve(self, size: int) -> None:
        if self.used + size > len(self.text):
            grown = np.zeros(max(2 * len(self.text), self.used + size), np.uint8)
            grown[: self.used] = self.text[: self.used]
            self.text = grown

    def _append(self, contexts: np.ndarray) -> None:
        self._reserve(len(contexts))
        self.text[self.used : self.used + len(contexts)] = contexts
        self.used += len(contexts)

    def _side_by_side(self, level: np.ndarray, ranked: np.ndarray) -> Iterator[tuple[slice, slice]]:
        """Slices of ``ranked`` and of ``level`` that hold the same part of the order."""
        starts = np.arange(0, len(level), SLICE)
        cuts = np.searchsorted(ranked, self.strings(level[starts]))
        cuts[0] = 0
        for a, b, at in zip(cuts, [*cuts[1:], len(ranked)], starts, strict=True):
            yield slice(int(a), int(b)), slice(int(at), int(at) + SLICE)

    def _common(self, places: np.ndarray, ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a slice of a level and a slice of sorted strings, neither with equal ones: which of the former and of the latter are equal. Both are scanned side by side: each string is looked for from the place of the one before."""
        if not len(ranked):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        theirs = self.strings(places)
        at = np.searchsorted(theirs, ranked)  # ascending, so the scan never goes back far
        at[at == len(theirs)] = 0
        here = np.flatnonzero(theirs[at] == ranked)
        return at[here], here

    def _merged(self, places: np.ndarray, ranked: np.ndarray) -> np.ndarray:
        """The order of a slice of a level followed by a slice of sorted strings (two ascending runs, which the stable sort merges)."""
        return np.argsort(np.concatenate([self.strings(places), ranked]), kind="stable") if len(ranked) else np.arange(len(places))

    def _push(self, array: np.ndarray) -> None:
        while self.levels and len(array) and len(self.levels[-1]) <= 2 * len(array):
            array = self._merge(self.levels.pop(), array)
        if len(array):
            self.levels.append(array)

    def _merge(self, level: np.ndarray, array: np.ndarray) -> np.ndarray:
        out, at = [], 0
        for k in range(0, len(array), BATCH_WINDOWS):
            block = array[k : k + BATCH_WINDOWS]
            last = k + BATCH_WINDOWS >= len(array)
            end = len(level) if last else bisect.bisect_left(range(len(level)), self.strings(array[k + BATCH_WINDOWS : k + BATCH_WINDOWS + 1])[0], key=lambda i: self.strings(level[i : i + 1])[0])
            part, ranked = level[at:end], self.strings(block)
            if len(part):
                for mine, theirs in self._side_by_side(part, ranked):
                    out.append(np.concatenate([part[theirs], block[mine]])[self._merged(part[theirs], ranked[mine])])
            else:
                out.append(block)
            at = end
        return np.concatenate(out)


def _ranked(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the windows, which of them in this order is the first of its like, and the sorted distinct windows."""
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    first = np.ones(len(ranked), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    return order, first, ranked[first]


def _same(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether ``sizes`` bytes at these places of a and of b are the same. Both are long enough for the largest size at each place."""
    out = np.empty(len(at), bool)
    for k in range(0, len(at), 10_000):
        some = slice(k, k + 10_000)
        most = int(sizes[some].max())
        left, right = (np.lib.stride_tricks.sliding_window_view(x, most)[t[some]] for x, t in ((a, at), (b, bt)))
        out[some] = ((left == right) | (np.arange(most) >= sizes[some][:, None])).all(axis=1)
    return out


def _window_places(sizes: np.ndarray, length: int) -> np.ndarray:
    """Places of all windows of contexts that stand one after the other."""
    counts = sizes - length + 1
    return np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _parts(sizes: np.ndarray, length: int) -> Iterator[slice]:
    """Slices of contexts with at most about a batch of windows each."""
    batch = np.cumsum(sizes - length + 1) // BATCH_WINDOWS
    edges = [0, *(np.flatnonzero(batch[1:] != batch[:-1]) + 1).tolist(), len(sizes)]
    return (slice(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b)


def _seen(family: SuffixFamily, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``family.add`` for contexts of any number, in batches."""
    ends = np.cumsum(sizes)
    out = [family.add(data[ends[p][0] - sizes[p][0] : ends[p][-1]], sizes[p]) for p in _parts(sizes, family.length)]
    return np.concatenate(out) if out else np.empty(0, bool)


class Anchors:
    """Contexts of a buffer of documents."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM) -> None:
        self.length, self.gram, self.up, self.down = length, gram, _powers(_BASE, 1), _powers(pow(_BASE, -1, 2**64), 1)

    def contexts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every context: the hash of its gram, its text's number, and start and end in the texts put together. They have under 2 ** 24 bytes, so that a place fits below the bits of a hash."""
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        n, length, gram = len(data), self.length, self.gram
        if n < length:
            return tuple(np.empty(0, np.int64) for _ in range(4))
        if n > int(_PLACE):
            raise ValueError("more than 2 ** 24 bytes in a chunk")
        if len(self.up) < n + 1:
            self.up, self.down = _powers(_BASE, n + 1), _powers(pow(_BASE, -1, 2**64), n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * self.up[:n], out=sums[1:])
        grams = _mix((sums[gram:] - sums[:-gram]) * self.down[: n - gram + 1])
        # The place of the least gram hash of every window; of equal ones the first.
        anchor = (_least((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), length - gram + 1) & _PLACE).astype(np.int64)
        ends = np.cumsum(sizes)
        # A window is one of a document if it ends in the document in which it starts.
        marks = np.zeros(len(anchor) + 2, np.int32)
        long = sizes >= length
        np.add.at(marks, (ends - sizes)[long], 1)
        np.add.at(marks, (ends - length + 1)[long], -1)
        valid = np.cumsum(marks)[: len(anchor)] > 0
        starts, lasts = valid.copy(), valid.copy()
        # The last windows of a document are not valid, so there is a gap before the next one's.
        starts[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
        lasts[:-1] &= (anchor[1:] != anchor[:-1]) | ~valid[1:]
        s, e = np.flatnonzero(starts), np.flatnonzero(lasts) + length
        return grams[anchor[s]].view(np.int64), np.searchsorted(ends, s, side="right"), s, e


def _chunks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Texts, ids, and where each text stands in its document. Segments of a long text overlap, so that each window is in one of them."""
    texts, ids, offsets, size = [], [], [], 0
    for batch in sliced(batches, 500):
        for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            raw = raw or b""
            for at in range(0, max(1, len(raw) - length + 1), CHUNK_BYTES):
                part = raw[at : at + CHUNK_BYTES + length - 1]
                if texts and size + len(part) > CHUNK_BYTES:
                    yield texts, np.array(ids, np.int64), np.array(offsets, np.int64)
                    texts, ids, offsets, size = [], [], [], 0
                texts.append(part)
                ids.append(i)
                offsets.append(at)
                size += len(part)
    if texts:
        yield texts, np.array(ids, np.int64), np.array(offsets, np.int64)


_ENTRY = "kind int, gram long, id long, start int, length int"
#: To be met by gram; known to share its gram; to be removed.
ENTRY, KNOWN, REMOVED = 0, 1, 2


def _entries(kind: np.ndarray, gram: np.ndarray, ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(ids), 50_000):
        part = [np.ascontiguousarray(x[at : at + 50_000]) for x in (kind.astype(np.int32), gram, ids, start.astype(np.int32), length.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in part], names=["kind", "gram", "id", "start", "length"])


def index(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Contexts of all documents (id, text), as ``ENTRY`` or ``KNOWN``, and the ranges that a chunk's family removes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, asked = Anchors(length), {}
        for texts, ids, offsets in _chunks(batches, length):
            gram, text, start, end = anchors.contexts(texts)
            begin = np.cumsum([0, *map(len, texts)])[:-1]
            doc, place, size = ids[text], start - begin[text] + offsets[text], end - start
            data = b"".join(texts)
            order = np.lexsort((place, doc))
            _, which, count = np.unique(gram, return_inverse=True, return_counts=True)
            again = order[count[which[order]] > 1]
            # A repeated row is no copy of itself.
            one, two = again[:-1], again[1:]
            twin = (doc[one] == doc[two]) & (place[one] == place[two]) & (size[one] == size[two])
            equal = [b for a, b in zip(one[twin].tolist(), two[twin].tolist(), strict=True) if data[start[a] : end[a]] == data[start[b] : end[b]]]
            again = again[~np.isin(again, equal)]
            kind = np.full(len(gram), ENTRY)
            seen = _seen(SuffixFamily(length), np.frombuffer(b"".join(data[a:b] for a, b in zip(start[again].tolist(), end[again].tolist(), strict=True)), np.uint8), size[again])
            fresh = np.add.reduceat((~seen).astype(np.int64), np.cumsum(size[again] - length + 1) - (size[again] - length + 1)) if len(again) else np.empty(0, np.int64)
            kind[again[fresh == 0]] = REMOVED
            left = again[fresh > 0]
            if asked:
                kind[[k for k, g in enumerate(gram.tolist()) if asked.get(g) == 2 and kind[k] == ENTRY]] = KNOWN
            for k, g in zip(left.tolist(), gram[left].tolist(), strict=True):
                if (n := asked.get(g, 0)) < 2:
                    asked[g] = n + 1
                else:
                    kind[k] = KNOWN
            rest = np.ones(len(gram), bool)
            rest[equal] = False
            yield from _entries(kind[rest], gram[rest], doc[rest], place[rest], size[rest])

    return map_batches(docs.select("id", "text"), run, _ENTRY)


def opened(entries: DataFrame) -> DataFrame:
    """``entries`` without those that are alone with their gram. Only ``ENTRY`` rows meet by gram; the others are dealt out evenly."""
    key = F.when(F.col("kind") == ENTRY, F.col("gram")).otherwise(F.xxhash64("id", "start", "kind"))
    rows = entries.select("*", (F.col("kind") == ENTRY).alias("asks"), key.alias("key"))
    near = Window.partitionBy("key", "asks").orderBy("id", "start")
    both = rows.select("*", F.lag("id").over(near).alias("before"), F.lead("id").over(near).alias("after"))
    return both.where(~F.col("asks") | F.col("before").isNotNull() | F.col("after").isNotNull()).select(entries.columns)


def _covered(sizes: np.ndarray, seen: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last window of each run of seen windows."""
    counts = sizes - length + 1
    row = np.repeat(np.arange(len(sizes)), counts)
    begin, end = seen.copy(), seen.copy()
    begin[1:] &= ~seen[:-1] | (row[1:] != row[:-1])
    end[:-1] &= ~seen[1:] | (row[1:] != row[:-1])
    base = np.cumsum(counts) - counts
    b, e = np.flatnonzero(begin), np.flatnonzero(end)
    return row[b], b - base[row[b]], e - base[row[e]]


#: Contexts of one gram that one family indexes; grams with more are dealt out to several.
FAMILY_CONTEXTS = 1000
#: Up to so many such grams are broadcast (16 bytes each).
MAX_BROADCAST_GRAMS = 500_000
_RESOLVED = "high long, low long, id long, start int, stop int"


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and sizes of an Arrow array of binary values without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, np.diff(offsets)


def families(contexts: DataFrame, length: int, number: int) -> DataFrame:
    """The contexts are dealt out by gram to so many families, of which a task has several, one after the other. Rows (id, start, stop) of windows that a task's family has seen before, and, of grams that are dealt out to several tasks (``shared``), rows with the digest (high, low) of each window that is the first in its family."""

    def resolved(family: SuffixFamily, batch: pa.RecordBatch, last: tuple | None) -> Iterator[pa.RecordBatch]:
        ids, starts, shared = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("id", "start", "shared"))
        data, sizes = _binary(batch.column("bytes"))
        ends = np.cumsum(sizes)
        row = lambda k: (batch.column("id")[k], batch.column("start")[k], batch.column("bytes")[k])
        # A repeated row is no copy of itself.
        one = np.flatnonzero((ids[1:] == ids[:-1]) & (starts[1:] == starts[:-1]) & (sizes[1:] == sizes[:-1]))
        once = np.ones(len(ids), bool)
        once[[k + 1 for k in one.tolist() if (data[ends[k] - sizes[k] : ends[k]] == data[ends[k] : ends[k + 1]]).all()]] = False
        once[0] = row(0) != last
        if not once.all():
            data, sizes, ids, starts, shared = data[np.repeat(once, sizes)], sizes[once], ids[once], starts[once], shared[once]
        seen = family.add(data, sizes)
        row, a, b = _covered(sizes, seen, length)
        none = pa.nulls(len(row), pa.int64())
        yield _resolved(none, none, ids[row], starts[row] + a, starts[row] + b + length)
        of = np.repeat(np.arange(len(sizes)), sizes - length + 1)
        places = _window_places(sizes, length)
        fresh = np.flatnonzero(shared[of] & ~seen)
        base = np.cumsum(sizes) - sizes
        for at in range(0, len(fresh), 20_000):
            some = fresh[at : at + 20_000]
            keys = np.frombuffer(b"".join(hashlib.blake2b(data[p : p + length].tobytes(), digest_size=16).digest() for p in places[some].tolist()), np.int64).reshape(-1, 2)
            begin = starts[of[some]] + places[some] - base[of[some]]
            yield _resolved(pa.array(keys[:, 0]), pa.array(keys[:, 1]), ids[of[some]], begin, begin + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, bucket, held, size, last = SuffixFamily(length), None, [], 0, None
        for batch in itertools.chain(_by_bucket(batches), [None]):
            mine = None if batch is None else batch.column("bucket")[0].as_py()
            if held and (size >= BATCH_WINDOWS or mine != bucket):
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                yield from resolved(family, whole, last)
                held, size, last = [], 0, tuple(whole.column(n)[whole.num_rows - 1] for n in ("id", "start", "bytes"))
            if batch is not None:
                if mine != bucket:
                    family, bucket, last = SuffixFamily(length), mine, None
                held.append(batch)
                size += pc.sum(pc.binary_length(batch.column("bytes"))).as_py() - (length - 1) * batch.num_rows

    tasks = min(number, parallelism(contexts.sparkSession))
    bucket = F.pmod(F.xxhash64("gram", "family"), F.lit(number)).cast("int")
    dealt = contexts.select(bucket.alias("bucket"), "id", "start", "bytes", "shared").repartitionById(tasks, F.col("bucket") % tasks)
    return map_batches(dealt.sortWithinPartitions("bucket", "id", "start", "bytes"), run, _RESOLVED)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches, each of one bucket."""
    for batch in sliced(batches, 500):
        buckets = batch.column("bucket").to_numpy()
        edges = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), len(buckets)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a < b:
                yield batch.slice(a, b - a)


def _resolved(high, low, ids, start, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([high, low, pa.array(ids), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["high", "low", "id", "start", "stop"])


def _listed(batch: pa.RecordBatch, name: str) -> tuple[list[bytes], np.ndarray, dict[str, np.ndarray]]:
    """The texts of a batch as bytes, and the structs of a column of lists put together: the row of each, and its fields."""
    lists = batch.column(name)
    row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    found = lists.flatten()
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], row, {f.name: x.to_numpy(zero_copy_only=False) for f, x in zip(found.type, found.flatten(), strict=True)}


def _merged_ranges(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges that overlap or touch within a row put together, in order: row, start, stop."""
    if not len(row):
        return row, start, stop
    order = np.lexsort((start, row))
    row, base = row[order], row[order].astype(np.int64) * (int(stop.max()) + 2)
    start, far = start[order], np.maximum.accumulate(stop[order] + base)
    first = np.concatenate([[True], start[1:] + base[1:] > far[:-1]])
    last = np.append(first[1:], True)
    return row[first], start[first], (far - base)[last]


def resolve(contexts: DataFrame, length: int, number: int, scratch: Scratch) -> DataFrame:
    """Ranges (id, start, stop) of windows that start earlier too, of contexts (gram, id, start, bytes, shared, family) that share a gram."""
    found = scratch(families(contexts, length, number), "suffix-families")
    inside = found.where(F.col("high").isNull()).select("id", "start", "stop")
    firsts = found.where(F.col("high").isNotNull())
    # A window has one row here for each of its gram's families at most.
    least = firsts.groupBy("high", "low").agg(F.min(F.struct("id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    across = firsts.join(least, ["high", "low"]).where((F.col("id") != F.col("first.id")) | (F.col("start") != F.col("first.start"))).select("id", "start", "stop")
    return inside.unionByName(across)


def repeated_ranges(docs: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """id, start, stop: all bytes that a window covers which starts earlier too, as ranges that may overlap. ``docs``: id (long, not null) and text."""
    entries = scratch(opened(index(docs, length)), "suffix-entries")
    gone = entries.where(F.col("kind") == REMOVED).select("id", "start", (F.col("start") + F.col("length")).alias("stop"))
    open_ = entries.where(F.col("kind") != REMOVED)
    windows = open_.agg(F.sum((F.col("length") - (length - 1)).cast("long"))).first()[0] or 0
    number = max(parallelism(docs.sparkSession), -(-windows // FAMILY_WINDOWS))
    # Grams with very many contexts are dealt out to several families by a hash of the document.
    hot = scratch(open_.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FAMILY_CONTEXTS), "suffix-hot-grams")
    parts = F.ceil(F.col("n") / FAMILY_CONTEXTS)
    few = F.broadcast(hot) if hot.count() <= MAX_BROADCAST_GRAMS else hot
    dealt = open_.join(few, "gram", "left").withColumn("shared", F.col("n").isNotNull()).withColumn("family", F.coalesce(F.pmod(F.xxhash64("id"), parts), F.lit(0)).cast("int"))
    wanted = dealt.groupBy("id").agg(F.collect_list(F.struct("gram", "start", "length", "shared", "family")).alias("wanted"))
    near = picked(docs.select("id", "text"), "id", id_filter(open_.select("id"))).join(wanted, "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 100):
            texts, row, want = _listed(batch, "wanted")
            size = want["length"]
            parts = [texts[r][s : s + n] for r, s, n in zip(row.tolist(), want["start"].tolist(), size.tolist(), strict=True)]
            # Rows that share an id may have shorter texts.
            whole = np.flatnonzero(np.fromiter(map(len, parts), np.int64, len(parts)) == size)
            ids = batch.column("id").to_numpy()[row]
            for k in range(0, len(whole), 20_000):
                some = whole[k : k + 20_000]
                columns = [pa.array(x[some]) for x in (want["gram"], ids, want["start"])] + [pa.array([parts[i] for i in some.tolist()], pa.binary())] + [pa.array(x[some]) for x in (want["shared"], want["family"])]
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "id", "start", "bytes", "shared", "family"])

    contexts = map_batches(near, cut, "gram long, id long, start int, bytes binary, shared boolean, family int")
    return gone.unionByName(resolve(contexts, length, number, scratch))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) for every row of ``docs`` (doc_id, text); other columns are ignored.

    A null text is an empty one. Rows without a doc_id come first in the order (at the place of the least long) and count as one document, as do rows that share a doc_id: equal rows are no copies of each
    other, and what is removed from one is removed at the same place of all. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text")
    scratch = Scratch()
    ranges = staged(repeated_ranges(docs.select("id", "text"), length, scratch), "suffix-ranges")
    scratch.clear()
    marks = id_filter(ranges.select("id"))
    by_doc = ranges.groupBy("id").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    touched = picked(docs, "id", marks).join(by_doc, "id", "left").select("doc_id", "text", "ranges")
    whole = picked(docs, "id", marks, inside=False).select("doc_id", "text", F.lit(None).cast(by_doc.schema["ranges"].dataType).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            if batch.num_rows:
                texts, row, found = _listed(batch, "ranges")
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                inside = found["start"] < sizes[row]  # rows that share an id may have shorter texts
                row, start, stop = _merged_ranges(row[inside], found["start"][inside].astype(np.int64), np.minimum(found["stop"], sizes[row])[inside])
                edges = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
                starts, stops, out = start.tolist(), stop.tolist(), []
                for raw, k, m in zip(texts, edges, edges[1:], strict=False):
                    kept = b"".join(raw[a:b] for a, b in zip([0, *stops[k:m]], [*starts[k:m], len(raw)], strict=True)) if k < m else raw
                    out.append((len(raw), len(raw) - len(kept), m - k, kept))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return map_batches(touched, run, schema).unionByName(map_batches(whole, run, schema))
