"""Shards of near equal bytes, as contiguous runs of an order in which equal texts are one atomic group.

Groups are ordered by the hash of their text. The smallest capacity into which a given number of contiguous
shards fit is found by bisection; a capacity is tried by filling shards one after the other. Cuts can only lie in
a few places of the order, so the driver begins with the sizes of hash ranges (a fixed number) and, again and again, has
those ranges split in which a cut can lie, until each of them is one group. What it holds is bounded at every step.
Where the capacity leaves room, cuts are set for even sizes.

Cases: null and empty text are one group of size 1 a row; a group larger than an even share sets the capacity;
repeated rows have slots of their own; a null id stays null; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch

#: Bits of the first ranges; the most ranges that one round of splitting makes.
RANGE_BITS, ROUND = 16, 1 << 18


def fill(ends: np.ndarray, capacity: int, shards: int, start: int = 0) -> list[int] | None:
    """Greedy cuts (indices into ``ends``, the running sizes) with at most ``capacity`` a shard; None if shards run out."""
    cuts, at = [], int(ends[start - 1]) if start else 0
    for _ in range(shards):
        if start == len(ends):
            break
        stop = int(np.searchsorted(ends, at + capacity, "right"))
        if stop == start:
            return None
        start, at = stop, int(ends[stop - 1])
        cuts.append(stop)
    return cuts if start == len(ends) else None


def smallest_capacity(sizes: np.ndarray, shards: int, low: int = 0) -> int:
    """Smallest capacity with which the groups, in order, fit into the shards."""
    ends = np.cumsum(sizes)
    low, high = max(low, -(-int(ends[-1]) // shards), int(sizes.max())), int(ends[-1])
    while low < high:
        mid = (low + high) // 2
        if fill(ends, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def even_cuts(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Cuts that keep to ``capacity`` and lie as near to even shares of the rest as that allows."""
    cuts, start = [], 0
    for left in range(shards, 0, -1):
        at, total = int(ends[start - 1]) if start else 0, int(ends[-1])
        if left == 1 or start == len(ends):
            cuts.append(len(ends))
            start = len(ends)
            continue
        most = int(np.searchsorted(ends, at + capacity, "right"))
        near = int(np.searchsorted(ends, at + (total - at) / left))
        goal = at + (total - at) / left
        if near > start and (near >= len(ends) or abs(int(ends[near - 1]) - goal) <= abs(int(ends[near]) - goal)):
            near -= 1
        stop = min(max(near + 1, start + 1), most)
        while stop < most and fill(ends, capacity, left - 1, stop) is None:
            stop += 1
        cuts.append(stop)
        start = stop
    return cuts


def _fluid(ends: np.ndarray, single: np.ndarray, capacity: int, shards: int) -> list[int]:
    """How far the shards reach if ranges of several groups could be cut anywhere: no real cut with that capacity lies beyond."""
    out, at = [], 0
    for _ in range(shards):
        stop = int(np.searchsorted(ends, at + capacity, "right"))
        if stop < len(ends) and single[stop]:
            at = max(at, int(ends[stop - 1]) if stop else 0)
        else:
            at = min(at + capacity, int(ends[-1]))
        out.append(at)
    return out


def _open(ends: np.ndarray, single: np.ndarray, low: int, high: int, shards: int) -> np.ndarray:
    """The ranges of several groups in which a cut can lie, for some capacity from ``low`` to ``high``."""
    inside, first = np.zeros(len(ends), bool), 0
    for last in _fluid(ends, single, high, shards):
        begins = int(np.searchsorted(ends, first + low, "right"))
        first = int(ends[begins - 1]) if begins else 0
        inside[begins : int(np.searchsorted(ends, last)) + 1] = True
    return np.flatnonzero(inside & ~single)


def plan(groups: DataFrame, shards: int, range_bits: int = RANGE_BITS, most: int = ROUND) -> tuple[int, list[int]]:
    """Capacity, and the hash at which each shard but the first begins. ``groups``: hash (each once) and size."""

    def ranges(rows: DataFrame, bits: int) -> np.ndarray:
        """Begin, bits, size and groups of each range of hashes that agree in their first ``bits``, and its largest group."""
        found = rows.groupBy(F.shiftright("hash", 64 - bits).alias("r")).agg(F.sum("size"), F.count("*"), F.max("size")).toPandas().to_numpy(np.int64)
        return np.column_stack([found[:, 0] << (64 - bits), np.full(len(found), bits), found[:, 1:]])

    table = ranges(groups, range_bits)
    if not len(table):
        return 0, []
    while True:
        table = table[np.argsort(table[:, 0])]
        ends, single = np.cumsum(table[:, 2]), table[:, 3] == 1
        high = smallest_capacity(table[:, 2], shards)
        low, top = max(-(-int(ends[-1]) // shards), int(table[:, 4].max())), high
        while low < top:  # what is too small even if all ranges could be cut anywhere
            mid = (low + top) // 2
            low, top = (low, mid) if _fluid(ends, single, mid, shards)[-1] == ends[-1] else (mid + 1, top)
        split = _open(ends, single, low, high, shards) if low < high else np.zeros(0, np.int64)
        if not len(split):
            break
        more = max(1, (most // len(split)).bit_length() - 1)
        new = []
        for bits in np.unique(table[split, 1]).tolist():
            begins = [(int(b) >> (64 - bits),) for b in table[split][table[split, 1] == bits, 0]]
            wanted = groups.sparkSession.createDataFrame(begins, "r bigint")
            new.append(ranges(groups.withColumn("r", F.shiftright("hash", 64 - bits)).join(F.broadcast(wanted), "r", "left_semi"), min(64, bits + more)))
        table = np.concatenate([np.delete(table, split, axis=0), *new])
    return high, [int(table[c, 0]) for c in even_cuts(ends, high, shards) if c < len(table)]


def shard(df: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns, per row: ``doc_id``, ``size`` (bytes of the text plus 1), ``text_crc32``, ``law``, ``shard``, ``slot`` (place in its shard), ``grown_shard`` (null under this law)."""
    scratch = Scratch(df.sparkSession, "sharding")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = scratch.keep(df.select(F.col(doc_id).cast("bigint").alias("doc_id"), (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("hash"), F.monotonically_increasing_id().alias("tie")))
    groups = scratch.keep(rows.groupBy("hash").agg(F.sum("size").alias("size")))
    _, starts = plan(groups, shards)
    number = sum([(F.col("hash") >= s).cast("int") for s in starts], F.lit(0))
    # within a partition the rows lie in order, so a row's place in the whole order is its place there plus what lies before
    laid = scratch.keep(rows.repartitionByRange("hash", "doc_id", "tie").sortWithinPartitions("hash", "doc_id", "tie").select("*", number.alias("shard"), F.monotonically_increasing_id().alias("_at")))
    placed = laid.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    parts = placed.groupBy("_part", "shard").agg(F.count("*").alias("n"), F.min("_row").alias("least")).collect()  # at most a row for each partition and cut
    before, at = {}, {}
    for p in sorted(parts, key=lambda p: (p["shard"], p["_part"])):
        before[p["_part"], p["shard"]] = at.get(p["shard"], 0) - p["least"]
        at[p["shard"]] = at.get(p["shard"], 0) + p["n"]
    offsets = df.sparkSession.createDataFrame([(int(p), int(s), int(n)) for (p, s), n in before.items()] or [(-1, -1, 0)], "_part bigint, shard int, _before bigint")
    return placed.join(F.broadcast(offsets), ["_part", "shard"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_row") + F.col("_before")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
