"""Sharding by minimax contiguous partition.

Documents with equal texts form an atomic group. Groups stand in the order of a 64-bit hash of their text, so a document's
place follows from its own text and no group has to be gathered. The smallest capacity for which a greedy pass over the group
sizes needs no more than the given number of shards is found by binary search, and the order is cut where that pass cuts.

The driver never sees the groups: it sees the total size of *cells*, ranges of the hash. A cell may be cut only at its
edges until it is known to hold a single hash. The search is run twice over the cells, once as if a cell could be cut anywhere (a lower
bound) and once as if it could not be cut (an upper bound, and a partition that is feasible); the cells between the two bounds are
split into finer ones until the bounds meet. Each round gathers at most ``MAX_CELLS`` new cells, and every round reads eight to
twelve more bits of the hash.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism, staged

FIRST_BITS = 12
MAX_CELLS = 1 << 16
#: Rows ranked by one task within a shard.
ROWS_PER_RANK_TASK = 100_000


def _greedy(edges: list[int], capacity: int, shards: int, divisible: bool) -> tuple[bool, list[tuple[int, int]]]:
    """Bounds (lowest, highest) of the size ahead of each cut; feasible if the last one reaches the total.

    ``edges`` are the sizes ahead of each cell's edges. The low bound always cuts at an edge; with ``divisible`` the high one may cut anywhere.
    """
    total, low, high, cuts = edges[-1], 0, 0, []
    for _ in range(shards):
        low = edges[bisect_right(edges, low + capacity) - 1]
        high = min(total, high + capacity)
        cuts.append((low, high))
    return (high if divisible else low) >= total, cuts


def _smallest(edges: list[int], low: int, high: int, shards: int, divisible: bool) -> int:
    while low < high:
        middle = (low + high) // 2
        if _greedy(edges, middle, shards, divisible)[0]:
            high = middle
        else:
            low = middle + 1
    return low


def _histogram(keys: DataFrame, spans: list[tuple[int, int]], bits: int) -> list[tuple[int, int, int]]:
    """(lowest hash, highest hash, size) of each non-empty cell in the spans, in order; the hashes are those that occur. There are no more spans than shards."""
    wanted = F.lit(False)
    for first, last in spans:
        wanted = wanted | F.col("key").between(first, last)
    rows = keys.where(wanted).groupBy(F.shiftright("key", 64 - bits).alias("cell")).agg(F.min("key").alias("first"), F.max("key").alias("last"), F.sum("size").alias("size"))
    return sorted(tuple(r) for r in rows.drop("cell").collect())


def plan_cuts(keys: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and for each shard but the last the highest hash in it. ``keys``: columns key and size."""
    bits = FIRST_BITS
    cells = _histogram(keys, [(-(2**63), 2**63 - 1)], bits)
    if not cells:
        return 0, []
    while True:
        edges = [0, *accumulate(c[2] for c in cells)]
        total = edges[-1]
        floor = max(-(-total // shards), *(c[2] for c in cells if c[0] == c[1]), 0)
        low = _smallest(edges, min(floor, total), total, shards, True)
        high = _smallest(edges, low, total, shards, False)
        if low == high:
            break
        optimist, pessimist = _greedy(edges, high, shards, True)[1], _greedy(edges, low, shards, False)[1]
        # For each cut the run of cells in which it may lie; runs that touch become one.
        runs: list[list[int]] = []
        for (_, up), (down, _) in zip(optimist, pessimist, strict=True):
            first, last = max(0, bisect_right(edges, down) - 1), min(len(cells), bisect_left(edges, up) + 1)
            if any(c[0] < c[1] for c in cells[first:last]):
                if runs and first <= runs[-1][1]:
                    runs[-1][1] = max(last, runs[-1][1])
                else:
                    runs.append([first, last])
        if not runs:
            break
        bits += max(1, min(8, 64 - bits, (MAX_CELLS // sum(b - a for a, b in runs)).bit_length() - 1))
        finer = _histogram(keys, [(cells[a][0], cells[b - 1][1]) for a, b in runs], bits)
        cells = sorted([c for i, c in enumerate(cells) if not any(a <= i < b for a, b in runs)] + finer)
    cuts, at = [], 0
    for _ in range(shards - 1):
        at = edges[bisect_right(edges, at + high) - 1]
        cuts.append(cells[bisect_left(edges, at) - 1][1] if at else -(2**63))
    return high, cuts


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs`` (doc_id, text).

    The law is ``bytes``. A null text is an empty one: size 1, checksum 0, one group with the empty texts. A null doc_id is kept. Equal rows get
    a slot each. With fewer groups than shards some shards stay empty; an empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = staged(
        docs.select(
            "doc_id",
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        ),
        "shard-keys",
    )
    _, cuts = plan_cuts(keys.select("key", "size"), shards)
    number = F.lit(0)
    for cut in cuts:
        number = number + (F.col("key") > cut).cast("int")
    placed = keys.withColumn("shard", number)
    # Slots: a shard may hold any number of rows, so they are ranked in bounded parts, each of which starts where the parts before it end.
    parts = max(1, -(-keys.count() // ROWS_PER_RANK_TASK), parallelism(docs.sparkSession) // shards)
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), F.lit(parts)).cast("int"))
    starts = (
        placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("start", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).drop("n")
    )
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "key")))
    return ranked.join(starts, ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("rank") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
