"""Language identification by a byte convolutional network.

Bytes are embedded; filters of several widths run over windows of fixed length;
each filter's largest value in a window goes through a rectifier to a softmax. The network is trained
here, in numpy, on a bounded sample of labelled texts. Prediction cuts every whole
text into windows and adds up their log probabilities, weighted by their bytes.

Cases: a text that is null or has no letter is ``und`` with score 0; with no labelled
text to learn from, every text is; ties go to the first language by name; rows
without a label are predicted but not learned from; other columns are carried along,
``lang_pred`` and ``score`` are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Scratch, map_arrow, unused
from .words import chunks, with_columns

UNDETERMINED = "und"


@dataclass(frozen=True)
class Config:
    """The sample that the network learns from is bounded: ``per_language`` texts (about; 1.5 times over all at most) of ``sample_chars`` characters. Every language is learned."""

    window: int = 256
    widths: tuple[int, ...] = (2, 4, 6)
    filters: int = 8
    embedding: int = 8
    per_language: int = 400
    sample_chars: int = 1024
    epochs: int = 6
    batch: int = 64
    rate: float = 0.01
    seed: int = 7


#: Up to so many languages their counts are broadcast to the texts.
_FEW = 10_000


@dataclass
class Net:
    """Weights; ``filters[i]`` has the shape (width, embedding, filters)."""

    languages: list[str]
    config: Config
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.bias, self.dense, self.dense_bias]


def fresh(languages: list[str], c: Config) -> Net:
    rng = np.random.default_rng(c.seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    total = c.filters * len(c.widths)
    return Net(
        languages, c, draw(256, c.embedding, scale=0.5),
        [draw(w, c.embedding, c.filters, scale=(w * c.embedding) ** -0.5) for w in c.widths],
        [np.zeros(c.filters, np.float32) for _ in c.widths],
        draw(total, len(languages), scale=total**-0.5), np.zeros(len(languages), np.float32),
    )


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], c: Config) -> Net:
    """Adam on the cross entropy, classes weighted to count alike. ``windows``: uint8, (n, window); labels: indices."""
    net = fresh(languages, c)
    weight = 1 / np.maximum(np.bincount(labels, minlength=len(languages)), 1)
    weight = (weight / weight[labels].mean()).astype(np.float32)
    rng = np.random.default_rng(c.seed)
    first, second = ([np.zeros_like(p) for p in net.parameters()] for _ in range(2))
    step = 0
    for _ in range(c.epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), c.batch):
            pick = order[at : at + c.batch]
            x, y = windows[pick], labels[pick]
            n = len(y)
            emb = net.embedding[x]
            pooled, top = [], []
            for f, b, w in zip(net.filters, net.bias, c.widths, strict=True):
                m = c.window - w + 1
                z = np.zeros((n, m, c.filters), np.float32)
                for j in range(w):
                    z += emb[:, j : j + m] @ f[j]
                top.append(z.argmax(axis=1))
                pooled.append(np.take_along_axis(z, top[-1][:, None], 1)[:, 0] + b)
            h = np.concatenate(pooled, axis=1)
            p = _softmax(np.maximum(h, 0) @ net.dense + net.dense_bias)
            p[np.arange(n), y] -= 1
            p *= (weight[y] / n)[:, None]
            g_h = (p @ net.dense.T) * (h > 0)
            g_emb = np.zeros_like(net.embedding)
            g_filters, g_bias = [], []
            for i, (f, w) in enumerate(zip(net.filters, c.widths, strict=True)):
                g = g_h[:, i * c.filters : (i + 1) * c.filters]
                g_bias.append(g.sum(axis=0))
                g_f = np.zeros_like(f)
                for j in range(w):
                    byte = np.take_along_axis(x, top[i] + j, 1)  # (n, filters): what each largest value saw
                    g_f[j] = np.einsum("nfe,nf->ef", net.embedding[byte], g)
                    np.add.at(g_emb, byte, g[:, :, None] * f[j].T[None])
                g_filters.append(g_f)
            grads = [g_emb, *g_filters, *g_bias, np.maximum(h, 0).T @ p, p.sum(axis=0)]
            step += 1
            for w, g, m, v in zip(net.parameters(), grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= c.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def cut(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over whole texts: bytes (n, size), each one's text, each one's own bytes.

    A text's last window is drawn back to end with the text; only a text shorter than a window is filled up, with spaces.
    """
    length = np.diff(offsets)
    count = -(-length // size)
    owner = np.repeat(np.arange(len(length)), count)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    own = np.minimum(size, length[owner] - k * size)
    start = offsets[owner] + np.maximum(np.minimum(k * size, length[owner] - size), 0)
    at = start[:, None] + np.arange(size)
    short = length[owner] < size
    out = data[np.minimum(at, len(data) - 1)] if len(data) else np.zeros((0, size), np.uint8)
    if short.any():
        out[short] = np.where(np.arange(size) < length[owner[short]][:, None], out[short], 32)
    return out, owner, own


def _pair_tables(net: Net) -> list[list[np.ndarray]]:
    """For each width, what two neighbouring bytes add at each even place of a filter; widths are even."""
    by_width = []
    for f, w in zip(net.filters, net.config.widths, strict=True):
        one = [net.embedding @ f[j] for j in range(w)]
        by_width.append([(one[j][:, None] + one[j + 1][None]).reshape(65536, -1) for j in range(0, w, 2)])
    return by_width


def _log_probabilities(net: Net, tables: list[list[np.ndarray]], x: np.ndarray, step: int = 256) -> np.ndarray:
    out = np.empty((len(x), len(net.languages)), np.float32)
    for at in range(0, len(x), step):
        part = x[at : at + step].astype(np.int32)
        pair = part[:, :-1] * 256 + part[:, 1:]
        pooled = []
        for w, by_place, b in zip(net.config.widths, tables, net.bias, strict=True):
            m = net.config.window - w + 1
            z = by_place[0].take(pair[:, :m], axis=0)
            for j, t in enumerate(by_place[1:], 1):
                z += t.take(pair[:, 2 * j : 2 * j + m], axis=0)
            pooled.append(z.max(axis=1) + b)
        out[at : at + step] = np.log(_softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ net.dense + net.dense_bias) + 1e-9)
    return out


def _predict(net: Net, text: str, letters: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _pair_tables(net)
        for rows, data, offsets in chunks(batches, text):
            x, owner, own = cut(data, offsets, net.config.window)
            total = np.zeros((rows.num_rows, len(net.languages)))
            for at in range(0, len(x), 8192):
                np.add.at(total, owner[at : at + 8192], _log_probabilities(net, tables, x[at : at + 8192]) * own[at : at + 8192, None])
            p = _softmax(total / np.maximum(np.diff(offsets), 1)[:, None])
            best = p.argmax(axis=1)
            known = rows.column(rows.schema.get_field_index(letters)).to_numpy(zero_copy_only=False)
            langs = np.where(known, np.array(net.languages, object)[best], UNDETERMINED)
            score = np.where(known, p[np.arange(len(p)), best], 0.0)
            yield with_columns(rows, {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(score.astype(np.float64))}, drop=(text, letters))

    return run


def sample(df: DataFrame, c: Config, text: str = "text", lang: str = "lang", key: str = "doc_id") -> list[tuple[str, str]]:
    """Labelled pieces of texts for training, on the driver: about ``per_language`` of each language, chosen by a hash of the key."""
    labelled = df.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = Scratch(df.sparkSession, "langid").keep(labelled.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n")))
    few = F.broadcast(counts) if (languages := counts.count()) <= _FEW else counts  # one row for each language
    if not languages:
        return []
    h = F.xxhash64(F.col(key), F.lit(c.seed))
    last = F.greatest(F.length(text) - c.sample_chars, F.lit(0))
    piece = F.substr(F.col(text), (F.pmod(F.xxhash64(F.col(key), F.lit(c.seed + 1)), last.cast("bigint") + 1) + 1).cast("int"), F.lit(c.sample_chars))
    share = F.least(F.lit(1.0), F.lit(1.2 * c.per_language) / F.col("n"))
    drawn = labelled.select(F.col(lang).alias("l"), piece.alias("t"), h.alias("h")).join(few, "l").where(F.pmod("h", F.lit(1 << 40)) < share * float(1 << 40))
    rows = drawn.select("l", "t", "h").orderBy("h", "l", "t").limit(int(1.5 * c.per_language * languages)).collect()
    return [(r.l, r.t) for r in rows]


def fit(df: DataFrame, c: Config = Config(), **columns: str) -> Net | None:
    """Train on a bounded sample of the labelled texts of ``df``; None if it has none."""
    rows = sample(df, c, **columns)
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    raw = [r[1].encode() for r in rows]
    x, owner, _ = cut(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), c.window)
    labels = np.array([languages.index(r[0]) for r in rows])[owner]
    return train(x, labels, languages, c)


def identify(df: DataFrame, net: Net | None, text: str = "text") -> DataFrame:
    """The table without ``text``, with ``lang_pred`` and ``score``."""
    rest = df.drop("lang_pred", "score")
    if net is None:
        return rest.drop(text).withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    letters: Column = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    (known,) = unused(rest, "letters")
    rest = rest.withColumn(known, letters)
    fields = [f for f in rest.schema.fields if f.name not in (text, known)]
    out = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_arrow(rest, _predict(net, text, known), out)
