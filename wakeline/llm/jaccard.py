"""Exact Jaccard join of documents on word n-grams by blocked sparse matrix products.

1. A document's set is its distinct n-grams as 64-bit hashes. Equal sets form a class; its smallest id stands for it.
2. Candidates: n-grams are put in one order for all documents, frequent ones last. Sets that overlap enough
   share ``SHARED`` of their first n-grams. Short posting lists give pairs, which may lack as many shared n-grams as
   both have in long lists; the members of a long list that have enough n-grams in such lists are only tied to its
   smallest member. Candidates form coarse components. Sets too small to link with a different one are left out.
3. In a coarse component the rows of the document by n-gram incidence are multiplied in blocks: overlap counts
   add up over column blocks, and pairs below the bound that their sizes give are discarded. A large
   component is cut into blocks of near sizes, each a file in the shared folder that is written once; only block
   pairs whose sizes allow a link are multiplied, by tasks that read both files. So disk grows with the documents,
   not with the square of a component. A block returns one row per linked document, never its pairs.

Cases: a null text or one without words has an empty set, which links with nothing; fewer words than ``k`` are
one n-gram; repeated rows are documents of their own that link with each other; an empty table gives an empty
one; other columns are ignored.
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

from .components import components
from .store import Scratch, map_arrow
from .words import _LANES, SPACED, Words, chunks, grams, mix, prefix_hash, scan

#: Above so many members a posting list ties them to one member instead of giving pairs.
LONG = 48
#: Of the first n-grams, so many have to be shared (fewer in small sets).
SHARED = 8
#: N-grams that more than FREQUENT documents have among their first are put last; at most MOST_FREQUENT of them are known to each task.
FREQUENT, MOST_FREQUENT = 8, 1_000_000
#: A block has at most so many documents and, unless one alone has more, so many n-grams.
BLOCK_DOCS, BLOCK_GRAMS = 256, 250_000
_COLUMNS = 4096
#: Block pairs of a task.
TASK_PAIRS = 32
#: Bits of the filter that keeps texts which are no candidates out of the shuffle.
FILTER_BITS = 1 << 26


def first_count(size: np.ndarray | int, percent: int) -> np.ndarray | int:
    """How many n-grams come first: any set linked with one of this size shares ``SHARED`` of its own first with these."""
    return np.minimum(size, size - (-(-percent * size // 100)) + SHARED)


def sets(words: Words, k: int) -> list[np.ndarray]:
    """The distinct n-grams of each text, in the order of their hashes."""
    g, at = grams(words, k)
    cut = np.searchsorted(at, words.first)
    out = [np.unique(g[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    count = words.count
    for d in np.flatnonzero((count > 0) & (count < k)):
        h = words.hash[words.first[d] : words.first[d + 1]]
        out[d] = mix((h * _LANES[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    return out


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat))


def _chunk_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for rows, data, offsets in chunks(batches, "text"):
        yield rows, sets(scan(data, offsets, SPACED, prefix_hash(data, True)), k)


def _describe(k: int, percent: int) -> Callable:
    """id, size, signature of the set, first n-grams in hash order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in _chunk_sets(batches, k):
            size = np.array([len(s) for s in found], np.int64)
            marks = [np.array([mix(s ^ np.uint64(c)).sum(dtype=np.uint64) for s in found], np.uint64).view(np.int64) for c in (0x51, 0xA7 << 40)]
            heads = [s[: first_count(len(s), percent)] for s in found]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(size), *map(pa.array, marks), _lists(heads)], ["doc_id", "size", "s1", "s2", "head"])

    return run


def _ordered_heads(k: int, percent: int, frequent: np.ndarray, rank: np.ndarray) -> Callable:
    """id, size, first n-grams with the frequent ones last. ``frequent`` is sorted; ``rank`` is their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in _chunk_sets(batches, k):
            heads = []
            for s in found:
                n = first_count(len(s), percent)
                at = np.searchsorted(frequent, s) if len(frequent) else np.zeros(len(s), np.int64)
                often = frequent[np.minimum(at, len(frequent) - 1)] == s if len(frequent) else np.zeros(len(s), bool)
                head = s[~often][:n]
                if len(head) < n:
                    late = s[often]
                    head = np.concatenate([head, late[np.argsort(rank[at[often]], kind="stable")][: n - len(head)]])
                heads.append(head)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(s) for s in found], pa.int64()), _lists(heads)], ["doc_id", "size", "head"])

    return run


def _known(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter of the nodes: a fixed number of bits, whatever their number. With very many nodes it lets all pass."""
    h = F.explode(F.array(*[F.pmod(F.xxhash64("node", F.lit(i)), F.lit(FILTER_BITS)) for i in range(2)]))
    bits = nodes.select(h.alias("h")).groupBy(F.shiftright("h", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 31 as int))")).alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[bits["at"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def _marked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("marks", F.array(*[F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(FILTER_BITS)) for i in range(2)]))


def _among(known: np.ndarray) -> Callable:
    """Keeps rows whose marks are all set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(2).flatten().to_numpy().reshape(-1, 2)
            there = ((known[h >> 5] >> (h & 31).astype(np.uint32)) & 1).all(axis=1)
            yield batch.select([0, 1]).filter(pa.array(there))

    return run


def overlaps(found: list[np.ndarray]) -> np.ndarray:
    """Product of the incidence matrix with its transpose: how many n-grams each two sets share (diagonal undefined)."""
    n = len(found)
    flat = np.concatenate(found)
    owner = np.repeat(np.arange(n), [len(s) for s in found])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    degree = np.diff(np.append(start, len(flat)))
    out = np.zeros((n, n), np.int64)
    for d in range(2, 9):  # thin columns, pair by pair
        at = start[degree == d]
        for i in range(d):
            for j in range(i + 1, d):
                if len(at):
                    out += np.bincount(owner[at + i] * n + owner[at + j], minlength=n * n).reshape(n, n)
    out += out.T
    wide = np.flatnonzero(degree > 8)
    for at in range(0, len(wide), _COLUMNS):  # full columns, as dense blocks
        cols = wide[at : at + _COLUMNS]
        m = np.zeros((n, len(cols)), np.float32)
        for c, col in enumerate(cols):
            m[owner[start[col] : start[col] + degree[col]], c] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def _roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that each row reaches."""
    label = ids.copy()
    i, j = np.nonzero(linked)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        if (new == label).all():
            return label
        label = new


@dataclass
class Block:
    """The sets of a block as pairs of n-gram and row, in the order of the n-grams."""

    ids: np.ndarray
    size: np.ndarray
    copies: np.ndarray
    gram: np.ndarray
    owner: np.ndarray


def _block(ids: np.ndarray, copies: np.ndarray, found: list[np.ndarray]) -> Block:
    flat = np.concatenate(found)
    size = np.array([len(s) for s in found], np.int64)
    order = np.argsort(flat, kind="stable")
    return Block(ids, size, copies, flat[order], np.repeat(np.arange(len(found), dtype=np.min_scalar_type(len(found))), size)[order])


def across(a: Block, b: Block) -> np.ndarray:
    """How many n-grams each set of ``a`` shares with each of ``b``."""
    out = np.zeros((len(a.ids), len(b.ids)), np.int64)
    if not len(a.gram) or not len(b.gram):
        return out
    both = [x.gram[np.minimum(np.searchsorted(x.gram, y.gram), len(x.gram) - 1)] == y.gram for x, y in ((b, a), (a, b))]
    gram, owner = zip(*((x.gram[m], x.owner[m]) for x, m in zip((a, b), both, strict=True)), strict=True)
    cols = np.unique(gram[0])
    at = [np.searchsorted(cols, g) for g in gram]
    for low in range(0, len(cols), _COLUMNS):
        m = []
        for n, c, o in zip(out.shape, at, owner, strict=True):
            x, y = np.searchsorted(c, [low, low + _COLUMNS])
            m.append(np.zeros((n, min(_COLUMNS, len(cols) - low)), np.float32))
            m[-1][o[x:y], c[x:y] - low] = 1
        out += (m[0] @ m[1].T).astype(np.int64)
    return out


_FOUND = "node bigint, root bigint, links bigint, whole boolean"
_INSIDE = f"component bigint, c int, i int, file string, {_FOUND}"


def _inside(k: int, percent: int, folder: str) -> Callable:
    """Links within a block: for each linked document, the smallest it reaches there and how many documents it links with.

    A block of a larger component is also written for its pairs with others; a row without a document names its file."""

    def run(table: pa.Table) -> pa.Table:
        ids, copies, found, seen = [], [], [], set()
        for rows, some in _chunk_sets(table.to_batches(), k):
            for node, size, n, s in zip(*(rows.column(c).to_pylist() for c in ("node", "size", "copies")), some, strict=True):
                if len(s) == size and (node, s.tobytes()) not in seen:  # not a repeated row of one document, nor another row of its id
                    seen.add((node, s.tobytes()))
                    ids.append(node)
                    copies.append(n)
                    found.append(s)
        whole, component, c, i = (table.column(x)[0].as_py() for x in ("whole", "component", "c", "i"))
        out: dict[str, list] = {"component": [], "c": [], "i": [], "file": [], "node": [], "root": [], "links": [], "whole": []}
        if found:
            names, many = np.array(ids, np.int64), np.array(copies, np.int64)
            size = np.array([len(s) for s in found])
            linked = ((100 + percent) * overlaps(found) >= percent * (size[:, None] + size[None, :])) & (names[:, None] != names[None, :])
            some, root, links = linked.any(axis=1), _roots(linked, names), linked @ many
            out["node"], out["root"], out["links"] = names[some].tolist(), root[some].tolist(), links[some].tolist()
            out["file"] = [None] * len(out["node"])
            if not whole:
                system, at = fs.FileSystem.from_uri(folder)
                system.create_dir(at, recursive=True)
                name = f"{uuid.uuid4().hex}.block"  # a task that runs twice leaves a file that no row names
                with system.open_output_stream(f"{at}/{name}") as f:
                    f.write(pickle.dumps(_block(names, many, found), 5))
                for x, v in (("node", None), ("root", None), ("links", None), ("file", f"{folder}/{name}")):
                    out[x].append(v)
        for x, v in (("component", component), ("c", c), ("i", i), ("whole", whole)):
            out[x] = [v] * len(out["node"])
        kinds = {"component": pa.int64(), "c": pa.int32(), "i": pa.int32(), "file": pa.string(), "node": pa.int64(), "root": pa.int64(), "links": pa.int64(), "whole": pa.bool_()}
        return pa.table({x: pa.array(v, kinds[x]) for x, v in out.items()})

    return run


def _load(path: str) -> Block:
    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_stream(at) as f:
        return pickle.loads(f.read())


def _between(percent: int) -> Callable:
    """Links between the two blocks of each pair of files, as ``_inside`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = _load(one), _load(two)
                linked = ((100 + percent) * across(a, b) >= percent * (a.size[:, None] + b.size[None, :])) & (a.ids[:, None] != b.ids[None, :])
                n, ids = len(a.ids), np.concatenate([a.ids, b.ids])
                both = np.zeros((len(ids), len(ids)), bool)
                both[:n, n:], both[n:, :n] = linked, linked.T
                some, links = both.any(axis=1), both @ np.concatenate([a.copies, b.copies])
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(_roots(both, ids)[some]), pa.array(links[some].astype(np.int64)), pa.array(np.zeros(some.sum(), bool))], ["node", "root", "links", "whole"])

    return run


def _blocks(nodes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Adds the block of each node, ``c`` and ``i``: its class of sizes and a part of it. A small component is one block, and ``whole``."""
    grow = F.lit(float(np.log(100 / percent)) * 1.0001)  # a little wide, so that rounding never sets linked sizes two classes apart
    nodes = nodes.withColumn("class", F.floor(F.log(F.col("size").cast("double")) / grow).cast("int"))
    by_class = scratch.keep(nodes.groupBy("component", "class").agg(F.count("*").alias("n"), F.sum("size").alias("g")))
    parts = F.ceil(F.greatest(F.col("n") / BLOCK_DOCS, F.col("g") / BLOCK_GRAMS)).cast("int").alias("parts")
    whole = by_class.groupBy("component").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).select("component", ((F.col("n") <= BLOCK_DOCS) & (F.col("g") <= 2 * BLOCK_GRAMS)).alias("whole"))
    table = scratch.keep(by_class.select("component", "class", parts).join(whole, "component"))
    at = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    own = lambda x: F.when(F.col("whole"), F.lit(0)).otherwise(x)
    return nodes.join(table, ["component", "class"]).withColumns({"c": own(F.col("class")), "i": own(at)})


def link(df: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Links documents whose sets of ``k``-word n-grams have a Jaccard similarity of ``percent`` or more.

    Returns, per row: ``doc_id``, ``n_shingles`` (size of its set), ``component_id`` (smallest id that links reach,
    its own included), ``n_links`` (documents that it links with).
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    all_docs = scratch.keep(map_arrow(docs, _describe(k, percent), "doc_id bigint, size bigint, s1 bigint, s2 bigint, head array<bigint>"))
    classes = scratch.keep(all_docs.where("size > 0").groupBy("s1", "s2", "size").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")))

    reps = classes.select("node", "size", "copies")
    first = all_docs.select("doc_id", "size", "head").join(reps.select(F.col("node").alias("doc_id"), "size"), ["doc_id", "size"])
    often = first.select(F.explode("head").alias("gram")).groupBy("gram").count().where(F.col("count") > FREQUENT).orderBy(F.desc("count"), "gram").limit(MOST_FREQUENT).toPandas()
    gram = often["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(gram)
    rank = np.empty(len(gram), np.int64)
    rank[np.lexsort((gram, often["count"].to_numpy()))] = np.arange(len(gram))

    heads = map_arrow(docs, _ordered_heads(k, percent, gram[order], rank[order]), "doc_id bigint, size bigint, head array<bigint>")
    able = reps.where(F.lit(100 - percent) * F.col("size") >= percent)  # a smaller set is not near any but its like
    entries = scratch.keep(heads.join(able.select(F.col("node").alias("doc_id"), "size"), ["doc_id", "size"]).select(F.col("doc_id").alias("node"), F.col("size").cast("int").alias("size"), F.explode("head").alias("gram")))
    lists = entries.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1")
    posts = scratch.keep(entries.join(lists, "gram"))
    scratch.drop(entries)
    in_long = posts.where(F.col("m") > LONG).groupBy("node").agg(F.count("*").cast("int").alias("long"))
    needed = lambda size: F.least(F.lit(SHARED), F.ceil(size * F.lit(percent) / 100)).cast("int")
    short = posts.where(F.col("m") <= LONG).join(in_long, "node", "left").groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("size", "node", F.coalesce("long", F.lit(0)).alias("long")))).alias("of"))
    near = lambda x, y: (F.lit(100) * x["size"] >= F.lit(percent) * y["size"]) & (x["node"] != y["node"])
    lack = lambda x, y: F.when(F.least(x["long"], y["long"]) < needed(y["size"]), F.least(x["long"], y["long"])).otherwise(F.lit(0))  # noqa: E731  # else a shared long list ties both
    pair = lambda x, y: F.struct(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b"), (needed(y["size"]) - lack(x, y)).alias("need"))
    pairs = F.flatten(F.transform("of", lambda x, i: F.transform(F.filter(F.slice("of", i + 2, F.size("of")), lambda y: near(x, y)), lambda y: pair(x, y))))
    counted = short.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"), F.min("p.need").alias("need")).where("n >= need").select("a", "b")
    ties = scratch.keep(posts.where(F.col("m") > LONG).join(in_long, "node").where(F.col("long") >= needed(F.col("size"))).select("gram", "node"))
    tied = ties.join(ties.groupBy("gram").agg(F.min("node").alias("a")), "gram").select("a", F.col("node").alias("b")).where("a <> b").distinct()
    coarse = scratch.keep(components(counted.unionByName(tied), scratch))
    scratch.drop(posts, ties)

    nodes = scratch.keep(coarse.join(reps, "node"))
    scratch.drop(coarse)
    keyed = scratch.keep(_blocks(nodes, percent, scratch).select("node", "size", "copies", "component", "whole", "c", "i"))
    scratch.drop(nodes)
    likely = map_arrow(_marked(docs), _among(_known(keyed.select("node"))), "doc_id bigint, text string")
    mine = keyed.withColumnRenamed("node", "doc_id").hint("merge")  # a broadcast would put two Python workers for each core into one stage
    rows = likely.join(mine, "doc_id").select(F.col("doc_id").alias("node"), "size", "copies", "component", "whole", "c", "i", "text")
    inside = scratch.keep(rows.groupBy("component", "c", "i").applyInArrow(_inside(k, percent, f"{scratch.path}/blocks"), _INSIDE))
    one, two = (inside.where("file is not null").select("component", *(F.col(x).alias(f"{x}{n}") for x in ("c", "i", "file"))) for n in (1, 2))
    meet = one.join(two.withColumn("c1", F.col("c2")), ["component", "c1"]).where("i1 < i2").unionByName(one.join(two.withColumn("c1", F.col("c2") - 1), ["component", "c1"]))
    work = scratch.keep(meet.select("file1", "file2"))
    found = inside.where("node is not null").select("node", "root", "links", "whole")
    if n := work.count():
        between = scratch.keep(map_arrow(work.repartition(1 + n // TASK_PAIRS, "file1", "file2"), _between(percent), _FOUND))
        found = found.unionByName(between)
    scratch.delete("blocks")
    scratch.drop(keyed)

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    over = components(found.where(~F.col("whole")).select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    labels = found.where("whole").select("node", F.col("root").alias("component_id")).unionByName(over.select("node", F.col("component").alias("component_id"))).groupBy("node").agg(F.min("component_id").alias("component_id"))
    named = scratch.keep(classes.join(labels, "node", "left").join(links, "node", "left").select("s1", "s2", "size", F.coalesce("component_id", "node").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    scratch.drop(inside, work, classes, *([between] if n else []))
    return all_docs.select("doc_id", "size", "s1", "s2").join(named, ["s1", "s2", "size"], "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
