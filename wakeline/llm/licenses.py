"""Licence notices in texts: exact phrases, and short notices with a few errors.

A notice that may differ in k edits is split into k + 1 pieces, of which one must stand unchanged. Exact
search for the pieces gives candidates; around each, the regex library matches the notice with
bounded errors and so verifies the edits and gives the span. Texts are searched as their lower-cased words
with one space between. Edits are counted in UTF-8 bytes.

Cases: a null text is empty; a text without words has no places, null ends, empty labels and score 0;
repeated rows are judged each; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import map_arrow
from .words import ALNUM, chunks, prefix_hash, scan

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    errors: int

    def pieces(self) -> list[tuple[int, bytes]]:
        """Place and bytes of ``errors`` + 1 pieces of near equal length."""
        raw, n = self.text.encode(), self.errors + 1
        cuts = [len(raw) * i // n for i in range(n + 1)]
        return [(a, raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


NOTICES = (
    Notice("apache-2.0", "licensed under the apache license", 3),
    Notice("mit", "released under the mit license", 2),
    Notice("mit", "permission is hereby granted free of charge", 4),
    Notice("gpl", "licensed under the gnu general public license", 4),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("mpl", "mozilla public license", 2),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("cc-by", "licensed under cc by", 1),
    Notice("cc-by-nc", "licensed under cc by nc", 1),
    Notice("cc-by", "creative commons attribution", 2),
    Notice("reserved", "all rights reserved", 1),
    Notice("public-domain", "dedicated to the public domain", 2),
)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[~ALNUM] = 32


def plain(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words with one space between and a line break at each text's end; and each byte's place in ``data``."""
    low = _LOWER[data]
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    place = np.concatenate([np.flatnonzero(keep), offsets[1:]])
    byte = np.concatenate([low[keep], np.full(len(offsets) - 1, 10, np.uint8)])
    order = np.lexsort((byte != 10, place))  # the end of a text comes before the first byte of the next
    return byte[order], place[order]


def find(notice: Notice, pattern: regex.Pattern, text: bytes) -> Iterator[tuple[int, int, int]]:
    """Spans of the notice in ``text`` and their edits, left to right, none over the end of a line."""
    k, size, windows = notice.errors, len(notice.text.encode()), set()
    for at, piece in notice.pieces():
        x = text.find(piece)
        while x >= 0:
            low, high = x - at - k, x - at + size + k
            ends = text.find(b"\n", x, max(high, x))
            windows.add((max(low, text.rfind(b"\n", max(low, 0), x) + 1, 0), ends if ends >= 0 else high))
            x = text.find(piece, x + 1)
    done = 0
    for a, b in sorted(windows):
        for m in pattern.finditer(text, max(a, done), min(b, len(text))):
            yield m.start(), m.end(), sum(m.fuzzy_counts)
            done = m.end()


def _phrases(hashes: np.ndarray, last: np.ndarray) -> dict[str, np.ndarray]:
    """Where each phrase begins. ``last``: for each word, where its text ends."""
    out = {}
    for phrase in PHRASES:
        raw = np.frombuffer(phrase.encode(), np.uint8)
        own = scan(raw, np.array([0, len(raw)]), ALNUM, prefix_hash(raw, True)).hash
        n = max(0, len(hashes) - len(own) + 1)
        there = np.arange(n) + len(own) <= last[:n]
        for j, h in enumerate(own):
            there &= hashes[j : j + n] == h
        out[phrase] = np.flatnonzero(there)
    return out


SPANS = "array<struct<label:string,first_word:bigint,last_word:bigint,errors:int>>"


def _scan(notices: tuple[Notice, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [regex.compile(rb"(?b)(?:%s){e<=%d}" % (regex.escape(n.text, literal_spaces=True).encode(), n.errors)) for n in notices]
        for rows, data, offsets in chunks(batches, "text"):
            n = rows.num_rows
            words = scan(data, offsets, ALNUM, prefix_hash(data, True))
            text_of = np.repeat(np.arange(n), words.count)
            base = _phrases(words.hash, np.repeat(words.first[1:], words.count))
            places = np.sort(np.concatenate(list(base.values())))
            in_text = text_of[places]
            n_base = np.bincount(in_text, minlength=n)
            first, last = np.full(n, -1), np.full(n, -1)
            first[in_text[::-1]] = (places - words.first[in_text])[::-1]
            last[in_text] = places - words.first[in_text]
            own: list[set] = [set() for _ in range(n)]
            for phrase, at in base.items():
                for t in np.unique(text_of[at]).tolist():
                    own[t].add(PHRASES[phrase])
            byte, place = plain(data, offsets)
            body = byte.tobytes()
            found: list[list] = [[] for _ in range(n)]
            score = (n_base > 0).astype(float)
            for notice, pattern in zip(notices, patterns, strict=True):
                for a, b, errors in find(notice, pattern, body):
                    w = int(np.searchsorted(words.end, place[a], "right"))
                    if w == len(text_of):
                        continue
                    t = int(text_of[w])
                    z = max(w, int(np.searchsorted(words.start, place[b - 1], "right")) - 1)
                    found[t].append({"label": notice.label, "first_word": w - int(words.first[t]), "last_word": z - int(words.first[t]), "errors": errors})
                    score[t] = max(score[t], 1 - errors / len(notice.text))
            join = lambda labels: ",".join(sorted(labels))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0), pa.array(words.count.astype(np.int64)), pa.array(n_base.astype(np.int64)),
                    pa.array(first, pa.int64(), mask=first < 0), pa.array(last, pa.int64(), mask=last < 0),
                    pa.array(map(join, own), pa.string()), pa.array([join(o | {f["label"] for f in fs}) for o, fs in zip(own, found, strict=True)], pa.string()),
                    pa.array(score), pa.array(found, pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int32())]))),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"],
            )

    return run


def scan_licenses(df: DataFrame, notices: tuple[Notice, ...] = NOTICES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns, per row: ``doc_id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``, ``notices`` (spans of words with their edits)."""
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return map_arrow(docs, _scan(notices), f"doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, notices {SPANS}")
