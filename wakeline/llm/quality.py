"""Quality rules with thresholds from the data, by language and source.

Each measure of a document goes into a quantile sketch of its language and source: counts of
logarithmic buckets, which merge by addition, whatever the order. There are no fixed cutoffs: a limit is the upper
quartile plus a multiple of the distance between the quartiles. Where the quartiles agree (most texts have none of it),
the next wider pair of quantiles that differ takes their place; where none differ, there is no scale and no limit.
Small groups take the limits of their language, small languages those of all. Documents meet the limits of their
group in a join and those beyond one are rejected.

Cases: a null text has no words and fails; null language or source is a group of its own; an empty table
gives an empty one; repeated rows count and are judged each; other columns, whatever their names, are carried along, but
``measure`` and ``score`` replace columns of the names of their own results.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Scratch, map_arrow, unused
from .words import SPACED, chunks, grams, mix, prefix_hash, scan, span_hash, with_columns

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_same", "n_marks", "n_upper", "n_letters")
VERDICT = ("base_failed", "reasons", "kept")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _LETTER[65:91] = _LETTER[97:123] = True
_MARK[33:127] = ~_LETTER[33:127]
_MARK[48:58] = False


@dataclass(frozen=True)
class Rule:
    """Reject when ``top`` over ``bottom`` is above the group's limit."""

    name: str
    top: str
    bottom: str


#: Shares that mark bad texts when they lie far above what is usual in their group. Marks are ASCII signs that are no letters or digits.
RULES = (
    Rule("symbols", "n_symbols", "n_words"),
    Rule("marks", "n_marks", "word_chars"),
    Rule("capitals", "n_upper", "n_letters"),
    Rule("repeats", "n_repeat_words", "n_words"),
    Rule("same", "n_same", "n_words"),
    Rule("lines", "n_dup_lines", "n_lines"),
    Rule("length", "word_chars", "n_words"),
)
#: Pairs of quantiles, in per cent, of which the first that differ give the scale.
PAIRS = ((25, 75), (10, 90), (5, 95), (2, 98), (1, 99))


@dataclass(frozen=True)
class Config:
    accuracy: float = 0.01
    spread: float = 8.0
    min_group: int = 100
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8


def count_texts(data: np.ndarray, offsets: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    """The counts of each text of a chunk."""
    n = len(offsets) - 1
    prefix = prefix_hash(data, False)
    words = scan(data, offsets, SPACED, prefix)
    total = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    per_text = lambda flags: np.diff(total(flags)[offsets])
    chars = total((data & 0xC0) != 0x80)
    length = total(chars[words.end] - chars[words.start])

    # lines end at \n and at the end of their text
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    start = start[start < len(data)]
    end = np.minimum(np.append(start[1:], len(data)), np.append(breaks, len(data))[np.searchsorted(breaks, start)])
    owner = np.searchsorted(offsets, start, "right") - 1
    full = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    owner, line = owner[full], span_hash(prefix, start[full], end[full])
    first = np.unique(line + mix(owner.astype(np.uint64)), return_index=True)[1]
    lines, distinct = np.bincount(owner, minlength=n), np.bincount(owner[first], minlength=n)

    g, at = grams(words, window)
    text_of = np.repeat(np.arange(n), words.count)
    same = total(np.concatenate([[False], (words.hash[1:] == words.hash[:-1]) & (text_of[1:] == text_of[:-1])])[: len(words.hash)])
    _, inverse, times = np.unique(g + mix(text_of[at].astype(np.uint64)), return_inverse=True, return_counts=True)
    found = at[times[inverse] > 1]
    cover = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(cover, found, 1)
    np.add.at(cover, found + window, -1)
    repeated = total(np.cumsum(cover[:-1]) > 0)
    return {
        "n_words": words.count, "word_chars": np.diff(length[words.first]), "n_symbols": per_text(_SYMBOL[data]), "n_dup_lines": lines - distinct,
        "n_repeat_words": np.diff(repeated[words.first]), "n_lines": lines, "n_same": np.diff(same[words.first]), "n_marks": per_text(_MARK[data]), "n_upper": per_text(_UPPER[data]), "n_letters": per_text(_LETTER[data]),
    }


def _measure(text: str, window: int, keep_text: bool, into: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, text):
            found = count_texts(data, offsets, window)
            packed = pa.StructArray.from_arrays([pa.array(found[k].astype(np.int64)) for k in COUNTS], list(COUNTS))
            yield with_columns(rows, {into: packed}, drop=() if keep_text else (text,))

    return run


def _measured(df: DataFrame, c: Config, text: str, keep_text: bool = False) -> tuple[DataFrame, str]:
    """The table with a column of all counts, and its name, which is none of the table's."""
    (into,) = unused(df, "counts")
    fields = [f for f in df.schema.fields if keep_text or f.name != text]
    counts = T.StructType([T.StructField(k, T.LongType()) for k in COUNTS])
    return map_arrow(df, _measure(text, c.window, keep_text, into), T.StructType([*fields, T.StructField(into, counts)])), into


def measure(df: DataFrame, c: Config = Config(), text: str = "text") -> DataFrame:
    """The counts beside the other columns; the text itself is left out."""
    found, into = _measured(df.drop(*COUNTS), c, text)
    return found.select("*", f"{into}.*").drop(into)


def _group(*columns: str) -> list[Column]:
    return [F.coalesce(F.concat(F.lit("="), F.col(x).cast("string")), F.lit("-")) for x in columns]


def _share(r: Rule, into: str) -> Column:
    return F.coalesce(F.try_divide(F.col(f"{into}.{r.top}").cast("double"), F.col(f"{into}.{r.bottom}").cast("double")), F.lit(0.0))


def sketches(measured: DataFrame, into: str, c: Config = Config(), lang: str = "lang", source: str = "source") -> DataFrame:
    """Mergeable sketches: how many documents of each language and source have each rule's share in each bucket. ``into``: the column of counts."""
    gamma = math.log((1 + c.accuracy) / (1 - c.accuracy))
    share = lambda r: F.when(_share(r, into) > 1e-6, F.ceil(F.log(_share(r, into)) / gamma).cast("int")).otherwise(-(1 << 30))
    entries = F.array(*[F.struct(F.lit(r.name).alias("rule"), share(r).alias("bucket")) for r in RULES])
    a, b = _group(lang, source)
    rows = measured.where(F.col(f"{into}.n_words") >= c.min_words).select(a.alias("lang_key"), b.alias("source_key"), F.explode(entries).alias("e"))
    return rows.groupBy("lang_key", "source_key", "e.rule", "e.bucket").agg(F.count("*").alias("n"))


def limits(sketch: DataFrame, c: Config = Config()) -> DataFrame:
    """A limit of each rule for each language and source, as ``limit``, a struct; null where no quantiles differ."""
    gamma = (1 + c.accuracy) / (1 - c.accuracy)
    value = lambda b: F.when(b > -(1 << 29), F.pow(F.lit(gamma), b) * 2 / (1 + gamma)).otherwise(0.0)

    def level(keys: list[str], name: str, least: int) -> DataFrame:
        merged = sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
        by = Window.partitionBy(*keys, "rule")  # the buckets of one rule: a few thousand at most, whatever the number of documents
        ranked = merged.select("*", F.sum("n").over(by).alias("all"), F.sum("n").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
        at = lambda q: F.min(F.when(100 * F.col("upto") >= q * F.col("all"), F.col("bucket")))
        q = ranked.groupBy(*keys, "rule").agg(F.max("all").alias("all"), *[at(p).alias(f"q{p}") for pair in PAIRS for p in pair])
        far = lambda lo, hi: F.when(hi > lo, value(hi) + c.spread * (value(hi) - value(lo)))
        return q.where(F.col("all") >= least).select(*keys, "rule", F.coalesce(*[far(F.col(f"q{lo}"), F.col(f"q{hi}")) for lo, hi in PAIRS]).alias(name))

    keys = ["lang_key", "source_key"]
    every = sketch.select(*keys, "rule").distinct()
    own, by_lang, of_all = level(keys, "own", c.min_group), level(keys[:1], "by_lang", c.min_group), level([], "of_all", 0)
    joined = every.join(own, [*keys, "rule"], "left").join(by_lang, ["lang_key", "rule"], "left").join(of_all, "rule", "left")
    wide = joined.groupBy(*keys).agg(*[F.max(F.when(F.col("rule") == r.name, F.coalesce("own", "by_lang", "of_all"))).alias(r.name) for r in RULES])
    return wide.select(*keys, F.struct(*[r.name for r in RULES]).alias("limit"))


def judge(measured: DataFrame, into: str, limit: DataFrame, c: Config = Config(), lang: str = "lang", source: str = "source") -> tuple[DataFrame, Column]:
    """The rows with their verdict: a struct of ``base_failed``, ``reasons`` (rules whose limit is passed, comma-joined) and ``kept``."""
    a, b, own = unused(measured, "lang_key", "source_key", "limit")
    keyed = measured.withColumns(dict(zip((a, b), _group(lang, source), strict=True)))
    met = keyed.join(limit.select(F.col("lang_key").alias(a), F.col("source_key").alias(b), F.col("limit").alias(own)), [a, b], "left")
    n = F.col(f"{into}.n_words")
    failed = (n < c.min_words) | (100 * F.col(f"{into}.n_repeat_words") > c.max_repeat_percent * n)
    over = F.array_join(F.array_compact(F.array(*[F.when(_share(r, into) > F.col(f"{own}.{r.name}"), r.name) for r in RULES])), ",")
    return met, F.struct(failed.alias("base_failed"), over.alias("reasons"), (~failed & (over == "")).alias("kept"))


def score(df: DataFrame, c: Config = Config(), text: str = "text", **columns: str) -> DataFrame:
    """Every document's counts and verdict beside its other columns, without its text."""
    scratch = Scratch(df.sparkSession, "quality")
    measured, into = _measured(df.drop(*COUNTS, *VERDICT), c, text)
    measured = scratch.keep(measured)
    rows, verdict = judge(measured, into, _limits(scratch, measured, into, c, **columns), c, **columns)
    return rows.select(*[x for x in measured.columns if x != into], f"{into}.*", *[verdict[x].alias(x) for x in VERDICT])


def keep_good(df: DataFrame, c: Config = Config(), text: str = "text", **columns: str) -> DataFrame:
    """The documents that no rule rejects, with the columns they came with."""
    scratch = Scratch(df.sparkSession, "quality")
    limit = _limits(scratch, *_measured(df, c, text), c, **columns)
    rows, verdict = judge(*_measured(df, c, text, keep_text=True), limit, c, **columns)
    return rows.where(verdict["kept"]).select(*df.columns)


def _limits(scratch: Scratch, measured: DataFrame, into: str, c: Config, **columns: str) -> DataFrame:
    sketch = scratch.keep(sketches(measured, into, c, **columns))
    limit = scratch.keep(limits(sketch, c))
    scratch.drop(sketch)
    return limit
