"""Similarity join on word n-grams: rare-first prefix filtering with length, positional and suffix filters.

1. Documents with equal sets are one node, known by a 64-bit digest and the set's size. Shingles have one order for all nodes, rare ones first. The prefix of a node is its first ``n - ceil(t n) + 1`` shingles; two sets
   that are similar enough share one. Any order gives the same links; the order decides how few candidates there are.
2. The order comes from exact counts, at any size of the corpus, though not all shingles are counted. First come the shingles of the *pool* (a fixed part of the hashes, twice the part of a set that a prefix takes) that one
   node alone has. A node with enough of these has no partner and is done, which holds for most texts that aren't near copies. Of the others all shingles are counted: those of the pool among all nodes, the rest
   among the nodes that are left, and they are ordered by these counts.
3. Nodes that share a prefix shingle are candidates if their sizes and places allow the overlap (length and positional filter) and so do the counts of their shingles in ranges of the hash (the suffix filter,
   with fixed pivots). A pair is verified once, whatever number of shingles it shares.
4. In a first round each node is compared with one hub of its shingle only, the node in which the shingle stands first. This joins a large group of near copies in linear work. Later only nodes
   that are still in different components are compared, within bands of like size, which decides on the same components as all pairs.

No key is hot: counts are combined before the shuffle, the entries of a shingle are dealt out in parts, each of which meets the shingle's hub (or the entries that it is compared with), and a hub that many nodes are
compared with is dealt out, its set once for each ``HUB_PAIRS`` of them.

Documents are read as bytes: words are what stands between ASCII white space, A-Z in lower case.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, id_filter, map_batches, picked, sliced, staged
from .components import components

SHINGLE = 3
#: Similarity as a fraction: 100 * intersection >= 90 * union.
THRESHOLD = (90, 100)
PIVOTS = 16
#: Candidates of one hub that meet one copy of its set.
HUB_PAIRS = 500
#: Entries of one shingle that are joined together.
PART_ENTRIES = 200
_CACHE_WORDS = 300_000


class Shingler:
    """Sets of shingle hashes of texts; hashes of words are remembered."""

    def __init__(self, size: int = SHINGLE) -> None:
        self.size, self.hash = size, {}

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes."""
        words = text.encode().lower().split() if text else []
        if not words:
            return np.empty(0, np.int64)
        if len(self.hash) > _CACHE_WORDS:
            self.hash = {}
        known = self.hash
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.array(list(map(known.__getitem__, words)), dtype=np.uint64)
        k = min(self.size, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
        return np.unique(out.view(np.int64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _digest(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _need(n: int, threshold: tuple[int, int]) -> int:
    """Least overlap that a set of n has with any set similar enough."""
    return -(-threshold[0] * n // threshold[1])


def _pool_end(threshold: tuple[int, int]) -> int:
    """Hashes below it (as signed numbers) are the pool: twice the share of a prefix."""
    share = min(Fraction(1), 2 * (1 - Fraction(*threshold)))
    return int(share * (2**64 - 1)) - 2**63


def profiles(docs: DataFrame, size: int, threshold: tuple[int, int]) -> DataFrame:
    """id, n, digest, pool (its shingles in the pool) and pivots (shingles in ranges of the hash) of every document."""
    end = _pool_end(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in sliced(batches, 1000):
            rows = []
            for t in batch.column(1).to_pylist():
                s = shingler.shingles(t)
                bins = np.bincount((s.view(np.uint64) >> np.uint64(60)).astype(np.int64), minlength=PIVOTS)
                rows.append((len(s), _digest(s), s[: int(np.searchsorted(s, end))], bins))
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=["id", "n", "digest", "pool", "pivots"])

    return map_batches(docs.select("id", "text"), run, "id long, n int, digest long, pool array<long>, pivots array<int>")


def node_sets(docs: DataFrame, nodes: DataFrame, size: int, start: int | None = None) -> DataFrame:
    """node and its whole set, or its shingles from ``start`` on, of ``nodes`` (node, id: of a document that has the set)."""
    near = picked(docs, "id", id_filter(nodes.select("id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, done = Shingler(size), set()
        for batch in sliced(batches, 64):
            rows = [(_digest(s), s if start is None else s[int(np.searchsorted(s, start)) :]) for s in map(shingler.shingles, batch.column(1).to_pylist())]
            rows = [r for r in rows if not (r[0] in done or done.add(r[0]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["node", "set"])

    # A few documents are picked that have a set of these but another id; rows that share an id are told apart by the digest.
    return map_batches(near.select("id", "text"), run, "node long, set array<long>").join(nodes.select("node"), "node", "left_semi").groupBy("node").agg(F.first("set").alias("set"))


def _last(threshold: tuple[int, int]):
    """The greatest place of a prefix."""
    return F.col("n") - F.ceil(F.col("n").cast("long") * threshold[0] / threshold[1] - 1e-9)


def _shared(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Of rows (node, shingle, ...): the shingles that several nodes have, with their number, and the rows that have one of them. Most shingles stand in one node; a bitmap keeps nearly all of these from the shuffle."""
    shared = staged(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") > 1), name)
    return shared, picked(rows, "shingle", id_filter(shared.select("shingle"))).join(shared, "shingle")


def prefixes(docs: DataFrame, nodes: DataFrame, size: int, threshold: tuple[int, int]) -> DataFrame:
    """shingle, node, n, i (its place in the order) and members (nodes that have it in their prefix) of the prefix shingles that more than one node has. ``nodes``: node, id, n and pool."""
    shared, mine = _shared(nodes.select("node", F.explode("pool").alias("shingle")), "join-shared")
    mine = staged(mine.select("node", "shingle", "sets"), "join-pool")
    counts = mine.groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    alone = F.size("pool") - F.coalesce("k", F.lit(0))
    left = staged(nodes.join(counts, "node", "left").select("node", "id", "n", F.size("pool").alias("pooled"), alone.alias("alone")).where(F.col("alone") <= _last(threshold)), "join-left")
    others = staged(node_sets(docs, left, size, _pool_end(threshold)), "join-others")
    also, theirs = _shared(others.select("node", F.explode("set").alias("shingle")), "join-also-shared")
    rows = mine.select("node", "shingle", "sets", F.lit(0).alias("kind")).unionByName(theirs.select("node", "shingle", "sets", F.lit(1).alias("kind")))
    of_node = Window.partitionBy("node")
    known = rows.join(left.drop("id"), "node")
    # Shingles that the node has alone come first: those of the pool, then the rest.
    single = F.col("alone") + F.col("n") - F.col("pooled") - F.sum("kind").over(of_node)
    placed = known.withColumn("i", (single + F.row_number().over(of_node.orderBy("sets", "kind", "shingle")) - 1).cast("int"))
    entries = staged(placed.where(F.col("i") <= _last(threshold)).select("shingle", "node", "n", "i"), "join-prefixes")
    for done in (shared, mine, left, others, also):
        discard(done)
    twice = entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
    out = staged(entries.join(twice, "shingle").select("shingle", "node", "n", "i", "members"), "join-entries")
    discard(entries)
    return out


def _overlap(threshold: tuple[int, int], a: str = "n", b: str = "m"):
    """Least overlap of two sets of these sizes: t / (1 + t) of their sum, rounded up."""
    f = Fraction(*threshold)
    f = f / (1 + f)
    return F.ceil((F.col(a).cast("long") + F.col(b)) * f.numerator / f.denominator - 1e-9)


def _possible(threshold: tuple[int, int]):
    """Length filter and positional filter on (n, i) and (m, j): sizes and places of the shared shingle."""
    low, high = threshold
    return (low * F.greatest("n", "m") <= high * F.least("n", "m")) & (F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= _overlap(threshold))


def _band(threshold: tuple[int, int], n: str):
    """Sets that are similar enough are in the same band of sizes or in neighbouring ones."""
    return F.floor(F.log(F.col(n).cast("double")) / (math.log(threshold[1] / threshold[0]) * 1.0001)).cast("int")


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, size: int, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose sets are similar enough, by their whole sets."""
    asked = staged(nodes.select("node", "id").join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node", "left_semi"), "join-asked")
    sets = staged(node_sets(docs, asked, size), "join-sets")
    discard(asked)
    # Each pair meets the set of its less frequent side by a plain key, and that of the other by a copy for so many pairs.
    counts = pairs.select(F.col("a").alias("x")).union(pairs.select(F.col("b").alias("x"))).groupBy("x").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HUB_PAIRS)
    many = staged(counts, "join-hubs")
    of = lambda side: many.select(F.col("x").alias(side), F.col("k").alias(f"k_{side}"))
    sized = pairs.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("k_a", F.lit(1)).alias("ka"), F.coalesce("k_b", F.lit(1)).alias("kb"))
    salt = lambda k, other: F.pmod(F.xxhash64(other), F.ceil(F.col(k) / HUB_PAIRS))
    salted = staged(sized.select("a", "b", salt("ka", "b").alias("sa"), salt("kb", "a").alias("sb")), "join-salted")

    def copies(side: str, name: str) -> DataFrame:
        wanted = salted.select(F.col(side).alias("node"), F.col(f"s{side}").alias("s")).distinct()
        return wanted.join(sets, "node").select(F.col("node").alias(side), F.col("s").alias(f"s{side}"), F.col("set").alias(name))

    both = salted.join(copies("a", "x"), ["a", "sa"]).join(copies("b", "y"), ["b", "sb"])
    common = F.size(F.array_intersect("x", "y"))
    alike = both.select("a", "b", common.alias("common"), (F.size("x") + F.size("y")).alias("sum")).where(threshold[1] * F.col("common") >= threshold[0] * (F.col("sum") - F.col("common")))
    out = staged(alike.select("a", "b").distinct(), "join-links")
    for done in (sets, many, salted):
        discard(done)
    return out


def _parts():
    """How many parts the entries of a shingle are dealt out to, from ``members``."""
    return F.ceil(F.col("members") / PART_ENTRIES).cast("int")


def _every_part():
    return F.explode(F.sequence(F.lit(0), _parts() - 1)).alias("part")


def link_classes(docs: DataFrame, size: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """id, n_shingles and component (the least id of its documents, null if none has one) of every row of ``docs`` (id, text). Rows with an empty set are linked with nothing."""
    rows = staged(profiles(docs, size, threshold), "join-profiles")
    full = rows.where(F.col("n") > 0)
    # Of equal sets one is kept; ``id`` is that of a document that has it.
    firsts = full.groupBy(F.col("digest").alias("node"), "n").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("pool", "pivots")))
    nodes = staged(firsts, "join-nodes")
    shared = prefixes(docs, nodes, size, threshold)
    # The hub of a shingle is the node in which it stands first; ties: the smaller set, then the smaller node.
    hubs = shared.groupBy("shingle").agg(F.min(F.struct("i", "n", "node")).alias("hub"), F.max("members").alias("members")).select("shingle", "hub", _every_part())
    part = F.pmod(F.xxhash64("node"), _parts()).cast("int")
    node = nodes.select("node", "pivots")

    def suffix_filtered(pairs: DataFrame) -> DataFrame:
        """The overlap is at most the sum over the ranges of the smaller of the two counts."""
        both = pairs.join(node.select(F.col("node").alias("a"), F.col("pivots").alias("p")), "a").join(node.select(F.col("node").alias("b"), F.col("pivots").alias("q")), "b")
        most = F.aggregate(F.zip_with("p", "q", lambda x, y: F.least(x, y)), F.lit(0), lambda acc, x: acc + x)
        return both.where(most >= _overlap(threshold)).select("a", "b", "n", "m")

    def of(pairs: DataFrame) -> DataFrame:
        """a < b, each pair once."""
        swap = F.col("a") > F.col("b")
        pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
        return suffix_filtered(pairs.select(pick("a", "b").alias("a"), pick("b", "a").alias("b"), pick("n", "m").alias("n"), pick("m", "n").alias("m")).distinct())

    star = shared.withColumn("part", part).join(hubs, ["shingle", "part"]).select(F.col("node").alias("a"), "n", "i", F.col("hub.node").alias("b"), F.col("hub.n").alias("m"), F.col("hub.i").alias("j")).where(F.col("a") != F.col("b")).where(_possible(threshold))
    first = staged(of(star), "join-star-pairs")
    links = verified(docs, first, nodes, size, threshold)
    found = components(links)

    labelled = shared.join(found.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = staged(labelled, "join-labelled")
    discard(shared)
    # Within a shingle only pairs of different components matter, so one of the two is outside the shingle's largest component.
    sizes = labelled.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("k"))
    major = sizes.groupBy("shingle").agg(F.max(F.struct("k", "component"))["component"].alias("major"), F.count(F.lit(1)).alias("components"), F.sum("k").alias("members")).where(F.col("components") > 1)
    mixed = labelled.withColumn("part", part).join(major.select("shingle", "major", _every_part()), ["shingle", "part"]).withColumn("band", _band(threshold, "n"))
    right = mixed.select("shingle", "part", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("node").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("component").alias("other"))
    left = mixed.where(F.col("component") != F.col("major")).select("shingle", "band", "component", F.col("node").alias("a"), "n", "i", _every_part())
    rest = left.join(right, ["shingle", "part", "band"]).where((F.col("component") != F.col("other")) & _possible(threshold))
    second = staged(of(rest).join(first.select("a", "b"), ["a", "b"], "left_anti"), "join-rest-pairs")
    classes = found if second.isEmpty() else components(links.unionByName(verified(docs, second, nodes, size, threshold)))
    for done in (first, links, labelled, second):
        discard(done)
    known = staged(nodes.select("node", "n", "id").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node")), "join-classes")
    discard(nodes)
    least = known.groupBy("component").agg(F.min("id").alias("least"))
    by_set = known.join(least, "component").select(F.col("node").alias("digest"), "n", "least")
    out = rows.select("id", "n", "digest").join(by_set, ["digest", "n"], "left")
    return out.select("id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component"))


def similar(docs: DataFrame, size: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text); other columns are ignored.

    A null or empty text has an empty set and is its own component. Rows are judged by their texts: those that share a doc_id, or have none, link as others do, each with what its own text is similar to. component_id is
    the least doc_id in the component, and null where no row of it has one. An empty table gives an empty result.
    """
    out = link_classes(docs.select(F.col("doc_id").alias("id"), "text"), size, threshold)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
