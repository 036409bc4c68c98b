"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is encoded from the shape of its words (letters, case, marks,
lengths, repetition); gated attention, learned from document labels alone, weighs the passages; a logistic unit scores
the weighted sum of their encodings.

Training takes at most ``PER_LABEL`` rows of each label, chosen by the hash of their id. Null, empty and wordless texts
are one passage of no words. Without labels of both kinds every score is 0.5. Repeated rows get equal scores; null ids
are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import labelled_sample
from .words import NOT_SPACE, Chunk, chunks, column_bytes, mix, small

PER_LABEL = 1500
PASSAGE = 64
HIDDEN, GATE = 16, 8


def _class(*codes: int | range) -> np.ndarray:
    table = np.zeros(256, bool)
    for c in codes:
        table[c if isinstance(c, int) else list(c)] = True
    return table


_CLASSES = [
    _class(range(65, 91)),  # upper case
    _class(range(97, 123)),  # lower case
    _class(range(48, 58)),  # digits
    _class(range(128, 256)),  # not ASCII
    _class(*map(ord, ".,;:?")),  # marks that end or part sentences
    _class(ord("!")),
    _class(ord("|")),
    _class(*map(ord, "*$&%#^~_=+<>{}[]\\")),  # other signs
    _class(*map(ord, "/@()\"'-")),
]
N_FEATURES = len(_CLASSES) + 9


def passages(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage, and its row; every row has one passage at least."""
    counts = np.diff(chunk.offset)
    per_row = np.maximum(1, -(-counts // PASSAGE))
    row = np.repeat(np.arange(len(counts)), per_row)
    index = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    x = np.zeros((len(row), N_FEATURES), np.float32)
    if not len(chunk.start):
        return x, row
    first = chunk.offset[row] + index * PASSAGE
    last = np.minimum(first + PASSAGE, chunk.offset[row + 1])
    full = np.flatnonzero(last > first)
    a, b = first[full], last[full]
    n = (b - a).astype(np.float32)
    of_word = np.repeat(np.arange(len(full)), b - a)
    size = np.bincount(of_word, weights=chunk.end - chunk.start)
    upper_of = None
    for k, table in enumerate(_CLASSES):
        c = np.cumsum(table[chunk.bytes], dtype=np.int32)
        x[full, k] = (c[chunk.end[b - 1] - 1] - c[chunk.start[a] - 1]) / size
        if k == 0:
            upper_of = c[chunk.end - 1] - c[chunk.start - 1]
        elif k == 1:
            shout = (upper_of > 0) & (c[chunk.end - 1] == c[chunk.start - 1])
    length = (chunk.end - chunk.start).astype(np.float32)
    h = chunk.hashes()
    same = np.zeros(len(h), np.float32)
    same[1:] = (h[1:] == h[:-1]) & (chunk.row[1:] == chunk.row[:-1])
    distinct = np.unique(mix(h ^ (of_word.astype(np.uint64) << np.uint64(40))) if len(full) else h, return_index=True)[1]
    # three words that the document has elsewhere too
    run = np.zeros(len(h), np.uint64)
    if len(h) >= 3:
        run[:-2] = h[:-2] + np.uint64(3) * h[1:-1] + np.uint64(5) * h[2:]
    run = mix(run + chunk.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(run, kind="stable")
    again = np.zeros(len(h), np.float32)
    s = run[order]
    eq = s[1:] == s[:-1]
    again[order[1:][eq]] = 1
    again[order[:-1][eq]] = 1
    breaks = np.cumsum(chunk.bytes == 10, dtype=np.int32)
    at = len(_CLASSES)
    mean = lambda v: np.bincount(of_word, weights=v, minlength=len(full)) / n
    m = mean(length)
    x[full, at] = m / 10
    x[full, at + 1] = np.sqrt(np.maximum(0, mean(length**2) - m**2)) / 10
    x[full, at + 2] = mean(shout.astype(np.float32))
    x[full, at + 3] = mean((length <= 3).astype(np.float32))
    x[full, at + 4] = mean(same)
    x[full, at + 5] = np.bincount(of_word[distinct], minlength=len(full)) / n
    x[full, at + 6] = mean(again)
    x[full, at + 7] = (breaks[chunk.end[b - 1]] - breaks[chunk.start[a]]) / n
    x[full, at + 8] = np.log2(n + 1) / 6
    return x, row


class Model:
    """h = tanh(Wx + c); attention ~ exp(v . (tanh(Ph) * sigmoid(Qh))); score = sigmoid(u . sum(attention * h) + d)."""

    def __init__(self, texts: list[bytes], labels: list[int], steps: int = 300):
        self.parts = None
        y = np.asarray(labels, np.float32)
        if not len(y) or y.min() == y.max():
            return
        xs, rows = [], []
        for c in chunks(texts, NOT_SPACE):
            x, row = passages(c)
            xs.append(x)
            rows.append(row + c.first)
        x, row = np.concatenate(xs), np.concatenate(rows)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        rng = np.random.Generator(np.random.PCG64(8))
        init = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.parts = [init(N_FEATURES, HIDDEN), np.zeros(HIDDEN, np.float32), init(HIDDEN, GATE), init(HIDDEN, GATE), init(GATE, 1)[:, 0], init(HIDDEN, 1)[:, 0], np.zeros(1, np.float32)]
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()).astype(np.float32)
        m, v = [np.zeros_like(p) for p in self.parts], [np.zeros_like(p) for p in self.parts]
        for t in range(1, steps + 1):
            for k, g in enumerate(self._gradients(x, row, y, weight)):
                g = g + 1e-4 * self.parts[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.parts[k] = self.parts[k] - 0.03 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)

    def _forward(self, x: np.ndarray, row: np.ndarray, n: int):
        w, c, p, q, v, u, d = self.parts
        h = np.tanh(x @ w + c)
        a, g = np.tanh(h @ p), 1 / (1 + np.exp(-(h @ q)))
        e = (a * g) @ v
        e = np.exp(np.clip(e, -30, 30))
        att = e / np.bincount(row, weights=e, minlength=n)[row]
        own = h @ u
        z = np.bincount(row, weights=att * own, minlength=n) + d[0]
        return h, a, g, att, own, 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def _gradients(self, x, row, y, weight):
        w, _, p, q, v, u, _ = self.parts
        n = len(y)
        h, a, g, att, own, s = self._forward(x, row, n)
        dz = (s - y) * weight
        each = (att * dz[row]).astype(np.float32)
        mean_own = np.bincount(row, weights=att * own, minlength=n)
        de = (each * (own - mean_own[row])).astype(np.float32)
        dag = de[:, None] * v[None]
        da, dg = dag * g * (1 - a * a), dag * a * g * (1 - g)
        dh = each[:, None] * u[None] + da @ p.T + dg @ q.T
        dpre = dh * (1 - h * h)
        return [x.T @ dpre, dpre.sum(axis=0), h.T @ da, h.T @ dg, (a * g).T @ de, h.T @ each, np.array([dz.sum()], np.float32)]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), 0.5)
        if self.parts is not None:
            for c in chunks(texts, NOT_SPACE):
                x, row = passages(c)
                out[c.first : c.first + len(c.texts)] = self._forward(np.clip((x - self.mean) / self.scale, -8, 8), row, len(c.texts))[5]
        return out

    def attention(self, text: bytes) -> list[float]:
        """The weight of each passage of one text; they sum to 1."""
        c = next(chunks([text], NOT_SPACE))
        x, row = passages(c)
        if self.parts is None:
            return [1 / len(row)] * len(row)
        return self._forward(np.clip((x - self.mean) / self.scale, -8, 8), row, 1)[3].tolist()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = PER_LABEL) -> Model:
    """Fits on at most about ``most`` rows of each label; pass in the documents, and the labels, that may be learned from."""
    got = labelled_sample(docs, labels, id_col, text_col, label_col, most)
    return Model([r.t.encode() for r in got], [int(r.y) for r in got])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) for every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.scores(column_bytes(batch.column("text"))))], names=["id", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
