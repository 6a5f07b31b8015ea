"""Packing of tokenised documents into sequences of a fixed length, with certificates.

Every partition packs its pieces best fit, largest first, and bounds from below by dual feasible functions how
many sequences any packing needs. A partition with a gap between the two takes documents from its emptiest sequences
to a meeting of several partitions, one without a gap those of its emptiest sequence alone. A meeting packs them anew
and keeps the result if it needs fewer sequences; so on, round by round, until all have met. Meetings are bounded in
size, whatever the number of partitions. ``certify`` holds the whole against the bound of all pieces.

Only documents longer than a sequence are cut: into full pieces, but for the first one, which has the rest. Full
pieces need no packing. Cases: a null or empty text is its end token alone; repeated rows are packed each; an
empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch, map_arrow
from .words import chunks

CAPACITY, END = 1024, 2
#: Pieces of a partition, about; documents that one partition takes to a meeting; partitions that meet.
PART, MOVED, MEET = 20_000, 2_000, 8

#: Fixed value: how the byte-level tokenizer splits a text before it merges bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _bytes_of(token: str) -> bytes:
    """A token of a byte-level vocabulary: printable bytes stand for themselves, the others, in order, for the code points from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    back = {b: b for b in plain} | {256 + i: b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    return bytes(back[ord(c)] for c in token)


class Encoder:
    """Ids of texts by a byte-level BPE tokenizer, as the tokenizers library gives them.

    Its vocabulary, in which ids follow the order of merges, is run by the faster tiktoken, and one text of every call by both:
    a difference is an error. Texts with characters on whose class libraries might differ (``unsettled``), or with a special
    token's string, go to tokenizers alone; a test holds the ids of all other characters, in several surroundings, against it.
    """

    def __init__(self, definition: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = {_bytes_of(t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in self.special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def slow(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, texts: list[str], plain: list[bool]) -> list[bytes]:
        """Little-endian 32-bit ids of each text. ``plain``: whether a text has none but common characters."""
        both, out = True, []
        for t, p in zip(texts, plain, strict=True):
            if not p or any(s in t for s in self.special):
                ids = self.slow(t)
            else:
                ids = self.fast.encode_ordinary(t)
                if both and 0 < len(t) < 10_000:
                    if ids != self.slow(t):
                        raise ValueError("the vocabulary is not one whose ids follow the order of merges")
                    both = False
            out.append(np.array(ids, "<u4").tobytes())
        return out


@cache
def _encoder(definition: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(definition)


def _class(character: str, category: str) -> str:
    """What the splitting pattern sees in a character: letter, number, space or none of them, as unassigned ones are."""
    return category[0] if category[0] in "LN" else "Z" if category[0] == "Z" or character in "\t\n\v\f\r" else "-"


@cache
def unsettled() -> str:
    """Pattern of characters on whose class libraries might differ: unassigned today, or of another class in Unicode 3.2; and controls that not all count as space."""
    odd = [
        i for i in range(0x110000)
        if (now := unicodedata.category(c := chr(i))) in ("Cn", "Cs") or _class(c, now) != _class(c, unicodedata.ucd_3_2_0.category(c)) or 0x1C <= i <= 0x1F or i == 0x85
    ]
    starts, ends = [i for i, before in zip(odd, [-1, *odd], strict=False) if i != before + 1], [i for i, after in zip(odd, [*odd[1:], -1], strict=True) if after != i + 1]
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True)) + "]"


#: Bytes of texts that have to be searched for unsettled characters: code points from U+0240 on, and controls.
_RARE = np.zeros(256, bool)
_RARE[0xC9:] = _RARE[0x1C:0x20] = True


def _pieces(definition: str, capacity: int, end: int, odd: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail, search = _encoder(definition), np.array([end], "<u4").tobytes(), re.compile(odd).search
        for rows, data, offsets in chunks(batches, "text"):
            rare = np.concatenate([[0], np.cumsum(_RARE[data] | ((data == 0xC2) & (np.append(data[1:], 0) == 0x85)))])[offsets]
            texts = rows.column(1).to_pylist()
            settled = [not r or not search(t) for t, r in zip(texts, np.diff(rare).tolist(), strict=True)]
            out: list[tuple] = []
            for doc, ids in zip(rows.column(0).to_pylist(), encode(texts, settled), strict=True):
                ids += tail
                n = len(ids) // 4
                start = 0
                for piece in range(-(-n // capacity)):
                    stop = start + capacity if piece else (n - 1) % capacity + 1
                    out.append((doc, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start = stop
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best fit, largest first: each one's bin and place in it; how many bins."""
    bin_of, place = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0  # bit r: some bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            b, room, n = n, capacity, n + 1
        bin_of[i], place[i] = b, capacity - room
        if room > s:
            by_room[room - s].append(b)
            mask |= 1 << (room - s)
    return bin_of, place, n


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """No packing needs fewer: the largest bound of two families of dual feasible functions.

    The first drops what is smaller than a threshold and takes what leaves less room than that as a whole bin; the second
    rounds to multiples of 1/k, up where the next multiple is not reached exactly.
    """
    return least_of_counts(np.bincount(sizes, minlength=capacity + 1)[: capacity + 1], capacity)


def least_of_counts(count: np.ndarray, capacity: int) -> int:
    """The bound from how many pieces there are of each length."""
    x = np.arange(capacity + 1)
    best = -(-int(count @ x) // capacity)
    rounded = [np.where((k + 1) * x % capacity == 0, x * k, (k + 1) * x // capacity * capacity) for k in range(1, 33)]  # times 1/k
    for t in range(capacity // 2 + 1):
        cut = np.where(x > capacity - t, capacity, np.where(x >= t, x, 0))
        best = max(best, -(-int(count @ cut) // capacity))
    for k, f in enumerate(rounded, 1):
        best = max(best, -(-int(count @ f) // (capacity * k)))
        for t in (capacity // 8, capacity // 4, capacity // 3, capacity // 2):
            cut = np.where(x > capacity - t, capacity, np.where(x >= t, x, 0))
            best = max(best, -(-int(count @ f[cut]) // (capacity * k)))
    return best


#: ``open``: taken to the next meeting.
_PACKED = "row bigint, part int, length bigint, sequence_id bigint, offset bigint, open boolean, gap int"


def _pack(capacity: int, level: int, last: bool) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("length").to_numpy()
        part = table.column("part")[0].as_py()
        bins, place, n = best_fit(sizes, capacity)
        gap = n - least_bins(sizes, capacity)
        base = (level << 50) + (part << 24)
        ids = bins + base
        if level:  # what these documents had before the meeting
            old, at = table.column("sequence_id").to_numpy(), table.column("offset").to_numpy()
            if n >= len(np.unique(old)):
                ids, place = old, at
        moved = np.zeros(len(sizes), bool)
        if not last:
            distinct, own = np.unique(ids, return_inverse=True)
            room = capacity - np.bincount(own, weights=sizes, minlength=len(distinct))
            order = np.argsort(-room, kind="stable")
            order = order[room[order] > 0]
            held = np.cumsum(np.bincount(own, minlength=len(distinct))[order])
            chosen = np.zeros(len(distinct), bool)
            chosen[order[held <= MOVED] if gap > 0 else order[:1]] = True
            moved = chosen[own]
        return pa.table({"row": table.column("row"), "part": pa.array(np.full(len(sizes), part, np.int32)), "length": table.column("length"), "sequence_id": pa.array(ids.astype(np.int64)), "offset": pa.array(place.astype(np.int64)), "open": pa.array(moved), "gap": pa.array(np.full(len(sizes), gap, np.int32))})

    return run


def tokenise(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every document: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``. ``tokenizer``: path of a definition, read here and sent to the tasks."""
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return map_arrow(docs, _pieces(definition, capacity, end, unsettled()), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces."""
    scratch = Scratch(pieces.sparkSession, "packing")
    rows = scratch.keep(pieces.withColumn("row", F.monotonically_increasing_id()))
    short = rows.where(F.col("length") < capacity)
    parts = max(1, math.ceil(short.count() / PART))
    now = short.select("row", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"), "length")
    done, level = [], 0
    while True:
        packed = scratch.keep(now.groupBy("part").applyInArrow(_pack(capacity, level, parts == 1), _PACKED))
        done.append(packed.where(~F.col("open")))
        if parts == 1 or not packed.where("open").limit(1).count():
            break
        parts, level = math.ceil(parts / MEET), level + 1
        now = packed.where("open").withColumn("part", F.floor(F.col("part") / MEET).cast("int"))
    placed = done[0]
    for d in done[1:]:
        placed = placed.unionByName(d)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = rows.where(F.col("length") == capacity).select(*columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return full.unionByName(rows.join(placed.select("row", "sequence_id", "offset"), "row").select(*columns, "sequence_id", "offset"))


def certify(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """How many sequences there are, and how many any packing of these pieces needs at least. Lengths are counted, so the driver gets a row for each length at most."""
    count = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").count().collect():
        count[r["length"]] = r["count"]
    return packed.select("sequence_id").distinct().count(), least_of_counts(count, capacity)
