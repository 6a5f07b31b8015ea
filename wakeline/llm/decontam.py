"""Benchmark passages in training texts, by suffix arrays over shards of the training words.

A shard is a slice of a partition. Its suffix array holds every suffix that can hold a window: those that
begin a long enough run of words which the benchmark knows. Every suffix of every item that is long enough
for a window, and whose first and last word the shard has, is searched in it by bisection, which gives all places of its
window; neighbouring windows on one diagonal make up the longest verbatim matches.

Items are made ready where they lie, in blocks of bounded size that are files in the shared folder; the driver knows
their names only. A task reads a lot of texts, holds one block after the other against it and gives the lot out: the
documents are read once, whatever the number of blocks, and nothing but the result is written.

Words are folded A-Z and compared by 64-bit hashes. Cases: a null text, or one without words, has no words and
no hits; an item without words is never found; items that share an id are one; a null item id reads "None"; repeated
rows are judged each; an empty benchmark finds nothing; other columns are carried along. ``search`` replaces columns of the
names of its own results, ``remove`` none.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Scratch, map_arrow, unused
from .words import _LANES, ALNUM, Words, chunks, mix, prefix_hash, scan, with_columns

#: Bytes of item texts in a block (which takes about five times as much in a task), and of the texts that a block is held against at once.
BLOCK_BYTES, LOT_BYTES = 4 << 20, 8 << 20
MATCHES = T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), T.StructField("doc_at", T.LongType()), T.StructField("item_at", T.LongType()), T.StructField("length", T.LongType())]))
RESULT = {"n_words": T.LongType(), "spans": T.ArrayType(T.LongType()), "matches": MATCHES}
_KINDS = {
    "n_words": pa.int64(), "spans": pa.list_(pa.int64()),
    "matches": pa.list_(pa.struct([("item_id", pa.string()), ("doc_at", pa.int64()), ("item_at", pa.int64()), ("length", pa.int64())])),
}


@dataclass
class Items:
    """A block of items: distinct windows as places in the items' word numbers, and who has them where."""

    ids: list[str]
    vocabulary: np.ndarray  # sorted hashes; a word's number is its place plus 1
    sequence: np.ndarray  # word numbers of all items, one after the other
    start: np.ndarray  # of each distinct window
    length: np.ndarray
    owner: np.ndarray  # of each window's places, by window
    at: np.ndarray
    first: np.ndarray
    window: int

    def rows(self, pick: np.ndarray) -> np.ndarray:
        """Windows as rows of word numbers; 0 fills up short ones."""
        steps = np.arange(self.window)
        out = self.sequence[np.minimum(self.start[pick][:, None] + steps, len(self.sequence) - 1)]
        out[steps >= self.length[pick][:, None]] = 0
        return out


def prepare(rows: list[tuple[object, str | None]], window: int = 10) -> Items:
    texts = [(t or "").encode() for _, t in rows]
    data = np.frombuffer(b"".join(texts), np.uint8)
    words = scan(data, np.cumsum([0, *map(len, texts)]), ALNUM, prefix_hash(data, True))
    vocabulary, number = np.unique(words.hash, return_inverse=True)
    n = words.count
    count = np.where(n >= window, n - window + 1, (n > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start, length = words.first[owner] + at, np.minimum(n[owner], window)
    key = length.astype(np.uint64)
    for j in range(window):
        key = key + np.where(j < length, words.hash[np.minimum(start + j, max(len(words.hash) - 1, 0))], np.uint64(0)) * _LANES[j]
    _, some, kind, times = np.unique(mix(key), return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(kind, kind="stable")
    small = lambda x: x.astype(np.int32)
    return Items([str(i) for i, _ in rows], vocabulary, small(number + 1), small(start[some]), small(length[some]), small(owner[order]), small(at[order]), np.cumsum([0, *times.tolist()]), window)


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``seq`` that are not 0, in the order of what follows up to ``depth`` or the next 0; by prefix doubling."""
    rank, k = np.append(seq, 0), 1
    while k < depth:
        ahead = np.append(rank[k:], np.zeros(k, rank.dtype))[: len(rank)]
        key = rank * (int(rank.max()) + 1) + ahead
        rank = np.where(rank > 0, np.unique(key, return_inverse=True)[1] + 1, 0)
        k *= 2
    order = np.argsort(rank, kind="stable")
    return order[np.searchsorted(rank[order], 1) :]


def bisect(seq: np.ndarray, sa: np.ndarray, windows: np.ndarray, length: np.ndarray, right: bool) -> np.ndarray:
    """For each window, where in the suffix array those that begin with it begin, or end."""
    low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(sa), np.int64)
    padded = np.append(seq, np.zeros(windows.shape[1], seq.dtype))
    steps, rows = np.arange(windows.shape[1]), np.arange(len(windows))
    own = steps < length[:, None]
    while (open_ := low < high).any():
        mid = (low + high) // 2
        there = padded[sa[np.minimum(mid, len(sa) - 1)][:, None] + steps]
        differ = (there != windows) & own
        k = differ.argmax(axis=1)
        equal = ~differ.any(axis=1)
        ahead = np.where(equal, right, there[rows, k] < windows[rows, k])
        low, high = np.where(open_ & ahead, mid + 1, low), np.where(open_ & ~ahead, mid, high)
    return low


def occurrences(items: Items, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of all windows in a shard: window, index of the word where it begins."""
    none = np.zeros(0, np.int64)
    if not len(hashes) or not len(items.start):
        return none, none
    at = np.minimum(np.searchsorted(items.vocabulary, hashes), len(items.vocabulary) - 1)
    number = np.where(items.vocabulary[at] == hashes, at + 1, 0)
    index = np.arange(len(number))
    # where the run of known words ends, for each word
    stop = np.where(number == 0, index, len(number))
    stop = np.minimum(np.minimum.accumulate(stop[::-1])[::-1], np.repeat(first[1:], np.diff(first)))
    begins = (number > 0) & (np.concatenate([[True], (stop[1:] != stop[:-1])]))
    runs = index[begins]
    runs = runs[stop[runs] - runs >= items.length.min()]
    size = stop[runs] - runs + 1  # with a 0 after each run
    if not len(runs):
        return none, none
    source = np.repeat(runs, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    seq = np.append(number, 0)[source]
    seq[np.cumsum(size) - 1] = 0
    sa = suffix_array(seq, items.window)
    there = np.zeros(len(items.vocabulary) + 1, bool)
    there[seq] = True
    pick = np.flatnonzero(there[items.sequence[items.start]] & there[items.sequence[items.start + items.length - 1]])
    windows, length = items.rows(pick), items.length[pick]
    low, high = (bisect(seq, sa, windows, length, right) for right in (False, True))
    times = high - low
    spot = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(pick, times), source[sa[spot]]


def longest(items: Items, window: np.ndarray, word: np.ndarray, text_of: np.ndarray, first: np.ndarray) -> dict[tuple[int, str], tuple[int, int, int]]:
    """Each text's and item's longest verbatim match: words, then place in the text and place in the item, both negative, so that of equal ones the first is the greatest."""
    times = np.diff(items.first)[window]
    spot = np.repeat(items.first[window], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    owner, at, word = items.owner[spot], items.at[spot], np.repeat(word, times)
    size = np.repeat(items.length[window], times)
    order = np.lexsort((at, word - at, owner, text_of[word]))
    owner, at, word, size = owner[order], at[order], word[order], size[order]
    text = text_of[word]
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (text[1:] != text[:-1]) | (word[1:] != word[:-1] + 1) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(at)) - 1
    best: dict[tuple[int, str], tuple[int, int, int]] = {}
    for h, n in zip(head.tolist(), (at[last] - at[head] + size[head]).tolist(), strict=True):
        key, value = (int(text[h]), items.ids[owner[h]]), (n, -int(word[h] - first[text[h]]), -int(at[h]))
        best[key] = max(best.get(key, value), value)
    return best


class _Shard:
    """Rows with their words, and what the blocks so far have found in them."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        self.rows = rows
        self.words: Words = scan(data, offsets, ALNUM, prefix_hash(data, True))
        self.text_of = np.repeat(np.arange(rows.num_rows, dtype=np.int32), self.words.count)
        self.hit = np.zeros(len(self.words.hash), bool)
        self.best: dict[tuple[int, str], tuple[int, int, int]] = {}

    def search(self, items: Items) -> None:
        window, word = occurrences(items, self.words.hash, self.words.first)
        if not len(word):
            return
        cover = np.zeros(len(self.hit) + 1, np.int64)
        np.add.at(cover, word, 1)
        np.add.at(cover, word + items.length[window], -1)
        self.hit |= np.cumsum(cover[:-1]) > 0
        for key, value in longest(items, window, word, self.text_of, self.words.first).items():
            self.best[key] = max(self.best.get(key, value), value)

    def result(self) -> dict[str, pa.Array]:
        hit, first, n = self.hit, self.words.first, self.rows.num_rows
        turn = np.zeros(len(hit) + 1, bool)  # a span never goes over the end of a text
        turn[first] = True
        before, after = np.concatenate([[False], hit[:-1]])[: len(hit)], np.append(hit[1:], False)[: len(hit)]
        start = np.flatnonzero(hit & (~before | turn[:-1]))
        end = np.flatnonzero(hit & (~after | turn[1:])) + 1
        spans: list[list[int]] = [[] for _ in range(n)]
        for a, b, t in zip(start.tolist(), end.tolist(), self.text_of[start].tolist(), strict=True):
            spans[t] += [a - int(first[t]), b - int(first[t])]
        matches: list[list[dict]] = [[] for _ in range(n)]
        for (t, item), (size, w, a) in sorted(self.best.items()):
            matches[t].append({"item_id": item, "doc_at": -w, "item_at": -a, "length": size})
        return {k: pa.array(v, _KINDS[k]) for k, v in (("n_words", self.words.count.tolist()), ("spans", spans), ("matches", matches))}


def _load(path: str) -> Items:
    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_stream(at) as f:
        return pickle.loads(f.read())


def _search(paths: list[str], text: str, names: dict[str, str]) -> Callable:
    """``names``: of the results that are wanted, and what to call them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: tuple[str, Items] | None = None

        def finish(lot: list[_Shard]) -> Iterator[pa.RecordBatch]:
            nonlocal block
            for path in paths:
                if block is None or block[0] != path:
                    block = None  # before the next one is read
                    block = (path, _load(path))
                for shard in lot:
                    shard.search(block[1])
            for shard in lot:
                found = shard.result()
                yield with_columns(shard.rows, {new: found[k] for k, new in names.items()})

        lot, size = [], 0
        for rows, data, offsets in chunks(batches, text):
            lot.append(_Shard(rows, data, offsets))
            size += len(data)
            if size >= LOT_BYTES or len(paths) < 2:  # one block is held anyway
                yield from finish(lot)
                lot, size = [], 0
        yield from finish(lot)

    return run


def _blocks(folder: str, window: int, limit: int) -> Callable:
    """Writes blocks of items and gives their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = fs.FileSystem.from_uri(folder)

        def put(rows: list) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.items"  # a task that runs twice leaves a file that no list names
            system.create_dir(at, recursive=True)
            with system.open_output_stream(f"{at}/{name}") as f:
                f.write(pickle.dumps(prepare(rows, window), 5))
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"]})

        held, size = [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((i, t))
                size += len(t or "")
                if size >= limit:
                    yield put(held)
                    held, size = [], 0
        if held:
            yield put(held)

    return run


def _found(df: DataFrame, benchmark: DataFrame, window: int, text: str, item_id: str, item_text: str, names: dict[str, str]) -> DataFrame:
    scratch = Scratch(df.sparkSession, "decontam")
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("None")).alias("i"), F.col(item_text).alias("t")).where(F.octet_length("t") > 0)
    size = items.agg(F.sum(F.octet_length("t").cast("bigint"))).first()[0] or 0
    listed = scratch.keep(map_arrow(items.repartition(1 + size // BLOCK_BYTES), _blocks(f"{scratch.path}/items", window, BLOCK_BYTES), "path string"))
    paths = sorted(r.path for r in listed.collect())  # a name for each BLOCK_BYTES of the benchmark
    return map_arrow(df, _search(paths, text, names), T.StructType([*df.schema.fields, *(T.StructField(new, RESULT[k]) for k, new in names.items())]))


def search(df: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Adds ``n_words``, ``spans`` (hit words: start, end, start, ...) and ``matches`` (each found item's longest verbatim match; of equal ones the first)."""
    return _found(df.drop(*RESULT), benchmark, window, text, item_id, item_text, {k: k for k in RESULT})


def report(df: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", **columns: str) -> DataFrame:
    """Returns, per row: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` (of the sorted, comma-joined ids), ``contaminated``, ``matches``."""
    pairs = F.transform(F.sequence(F.lit(0), F.size("spans").cast("int")), lambda i: F.when(i % 2 == 1, F.get("spans", i) - F.get("spans", i - 1)).otherwise(F.lit(0)))
    hit = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    ids = F.array_join(F.array_sort(F.transform("matches", lambda m: m["item_id"])), ",")
    found = search(df.select(F.col(doc_id).alias("doc_id"), F.col(columns.get("text", "text"))), benchmark, window, **columns)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("matches").cast("bigint").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "matches")


def remove(df: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents in which no item's window occurs, with the columns they came with."""
    (spans,) = unused(df, "spans")
    return _found(df, benchmark, window, text, item_id, item_text, {"spans": spans}).where(F.size(spans) == 0).select(*df.columns)
