"""Toxicity by multiple-instance learning: sentences are instances, documents carry the labels.

A sentence's chance of being toxic is a logistic function of its words and of their beginnings; a document's is the noisy-or of its sentences',
1 - prod(1 - p). The weights are trained from document labels only, through the noisy-or. The same sentence chances
then locate the offending sentences.

Training takes at most ``PER_LABEL`` rows of each label, chosen by the hash of their id, and learns from their whole texts,
which stand in a file of the driver's own and not in its memory. Null and empty texts have no
sentence and score 0. Without labels of both kinds every score is 0 (or, with toxic labels alone, still 0). Repeated
rows get equal scores; null ids are kept.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import labelled_spool
from .words import LETTERS, Chunk, chunks, column_bytes, small

PER_LABEL = 3000
#: A word or beginning takes part if so many documents of the sample have it, and its share of toxic ones is so many standard deviations off.
LEAST_DOCUMENTS, LEAST_DEVIATION = 4, 4.0
PREFIXES = (4, 5, 6, 7, 8)
#: Words and beginnings that are counted at once; words and sentences that a step of training holds at once.
COUNTED, SEGMENT = 1 << 20, 1 << 21
_ENDS = np.zeros(256, np.int32)
_ENDS[[0x21, 0x2E, 0x3F, 0x0A]] = 1


def sentences(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The sentence of each word and the row of each sentence; sentences without words are left out."""
    if not len(chunk.start):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.cumsum(_ENDS[chunk.bytes])[chunk.start]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (chunk.row[1:] != chunk.row[:-1])
    return np.cumsum(new) - 1, chunk.row[new]


def _summed(tables: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, sums, sums): the counts of equal hashes added up."""
    h, at = np.unique(np.concatenate([t[0] for t in tables]), return_inverse=True)
    return h, *(np.bincount(at, weights=np.concatenate([t[k] for t in tables]), minlength=len(h)) for k in (1, 2))


def telling(texts: Sequence[bytes], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words and beginnings that take part, as sorted hashes, with the numbers of documents and of toxic ones that have each.

    They are counted in a range of hashes at a time: where more than COUNTED fall into it, it is halved, and another pass
    over the texts counts the rest.
    """
    none = np.empty(0, np.uint64), np.empty(0), np.empty(0)
    out, rate, first = [none], y.mean(), np.uint64(0)
    while first is not None:
        held, more, n, end = none, [], 0, None
        for c in chunks(texts, LETTERS, latin=True):
            h, row = (np.concatenate(x) for x in zip(*((h, c.row[of]) for of, h in c.parts(PREFIXES)), strict=True))
            if first or end is not None:
                ok = (h >= first) & (h < end) if end is not None else h >= first
                h, row = h[ok], row[ok]
            hashes, word = np.unique(h, return_inverse=True)
            pair = np.unique(word * len(c.texts) + row)
            own, of_row = pair // len(c.texts), y[c.first + pair % len(c.texts)]
            more.append((hashes, np.bincount(own, minlength=len(hashes)), np.bincount(own, weights=of_row, minlength=len(hashes))))
            n += len(hashes)
            if n > max(len(held[0]) // 2, COUNTED // 4) or c.first + len(c.texts) == len(texts):
                held, more, n = _summed([held, *more]), [], 0
                if len(held[0]) > COUNTED:
                    end = held[0][COUNTED // 2]
                    held = tuple(x[: COUNTED // 2] for x in held)
        off = (held[2] - rate * held[1]) / np.sqrt(held[1] * rate * (1 - rate) + 1e-9)
        known = (held[1] >= LEAST_DOCUMENTS) & (np.abs(off) >= LEAST_DEVIATION)
        out.append(tuple(x[known] for x in held))
        first = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Segments:
    """Where the words that take part stand: (first row, last row, sentences, word, sentence, row of each sentence), some
    rows at a time, from a file of the driver's own."""

    def __init__(self, texts: Sequence[bytes], vocabulary: np.ndarray):
        self.file, self.made = tempfile.TemporaryFile(), []
        parts, first, n = ([], [], []), 0, 0
        for c in chunks(texts, LETTERS, latin=True):
            s, r = sentences(c)
            for of, h in c.parts(PREFIXES):
                if len(vocabulary) and len(of):
                    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                    hit = np.flatnonzero(vocabulary[at] == h)
                    parts[0].append(at[hit].astype(np.int32))
                    parts[1].append((s[of[hit]] + n).astype(np.int32))
            parts[2].append((r + (c.first - first)).astype(np.int32))
            n += len(r)
            last = c.first + len(c.texts)
            if last == len(texts) or n + sum(map(len, parts[0])) >= SEGMENT:
                sizes = [sum(map(len, x)) for x in parts]
                self.made.append((first, last, n, self.file.tell(), sizes))
                for x in parts:
                    for a in x:
                        self.file.write(a.tobytes())
                parts, first, n = ([], [], []), last, 0
        self.file.flush()

    def __iter__(self) -> Iterator[tuple]:
        for first, last, n, at, sizes in self.made:
            whole = np.memmap(self.file, np.int32, "r", at, sum(sizes)) if sum(sizes) else np.empty(0, np.int32)
            yield first, last, n, *np.split(whole, np.cumsum(sizes)[:2])


class Model:
    def __init__(self, texts: Sequence[bytes], labels: list[int], steps: int = 250):
        self.vocabulary, self.weights, self.bias = np.empty(0, np.uint64), np.empty(0), -np.inf
        y = np.asarray(labels, float)
        if not len(y) or y.min() == y.max():
            return
        # passes over the texts, chunk by chunk: which words take part, and where they stand
        vocabulary, df, df1 = telling(texts, y)
        segments = Segments(texts, vocabulary)
        # starts from how much more often a word stands in toxic documents
        w = np.log((df1 + 0.5) / (y.sum() + 1)) - np.log((df - df1 + 0.5) / ((1 - y).sum() + 1))
        w = np.where(w > 1, w, 0.0)
        b = -6.0
        balance = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
        state = [np.zeros_like(w), np.zeros_like(w), 0.0, 0.0]
        for t in range(1, steps + 1):
            grads = [np.zeros_like(w), 0.0]
            for first, last, n, word, of, row in segments:
                z = np.bincount(of, weights=w[word], minlength=n) + b
                p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                clean = np.exp(-np.bincount(row, weights=np.logaddexp(0, z), minlength=last - first))
                slope = np.where(y[first:last] == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0) * balance[first:last]
                g = p * slope[row]
                grads[0] += np.bincount(word, weights=g[of], minlength=len(w))
                grads[1] += g.sum()
            rate = 0.1
            for k, grad in enumerate(grads):
                state[2 * k] = 0.9 * state[2 * k] + 0.1 * grad
                state[2 * k + 1] = 0.99 * state[2 * k + 1] + 0.01 * grad * grad
                step = rate * (state[2 * k] / (1 - 0.9**t)) / (np.sqrt(state[2 * k + 1] / (1 - 0.99**t)) + 1e-8)
                if k == 0:
                    w = w - step
                    w = np.sign(w) * np.maximum(np.abs(w) - 0.01, 0)  # words without a say fall to 0
                else:
                    b = b - step
        self.vocabulary, self.weights, self.bias = vocabulary[w != 0], w[w != 0], float(b)

    def chances(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """softplus of each sentence's logit (so that noisy-or is a sum), its row, and the sentence of each word."""
        sentence, row = sentences(chunk)
        z = np.full(len(row), self.bias)
        if len(self.vocabulary) and len(sentence):
            for of, h in chunk.parts(PREFIXES):
                at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
                hit = np.flatnonzero(self.vocabulary[at] == h)
                z += np.bincount(sentence[of[hit]], weights=self.weights[at[hit]], minlength=len(row))
        return np.logaddexp(0, z), row, sentence

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for c in chunks(texts, LETTERS, latin=True):
            soft, row, _ = self.chances(c)
            out[c.first : c.first + len(c.texts)] = -np.expm1(-np.bincount(row, weights=soft, minlength=len(c.texts)))
        return np.clip(out, 0, 1)

    def offending(self, text: bytes, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, chance) in bytes of the sentences at or over ``least``, from the first to the last word."""
        out = []
        for c in chunks([text], LETTERS, latin=True):
            soft, _, sentence = self.chances(c)
            for k in np.flatnonzero(-np.expm1(-soft) >= least).tolist():
                of = np.flatnonzero(sentence == k)
                out.append((int(c.start[of[0]]) - 1, int(c.end[of[-1]]) - 1, float(-np.expm1(-soft[k]))))
        return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = PER_LABEL) -> Model:
    """Fits on at most about ``most`` rows of each label; pass in the documents, and the labels, that may be learned from."""
    got = labelled_spool(docs, labels, id_col, text_col, label_col, most)
    return Model(got, got.labels)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """(id_col, score) for every row; with ``spans`` also the offending sentences as (start, end, chance) in bytes."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = column_bytes(batch.column("text"))
            out = {"id": batch.column("id"), "score": pa.array(model.scores(texts))}
            if spans:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("chance", pa.float64())]))
                out["sentences"] = pa.array([[dict(zip(("start", "end", "chance"), x, strict=True)) for x in model.offending(t)] for t in texts], kind)
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    kind = rows.schema["id"].dataType.simpleString()
    more = ", sentences array<struct<start:int,end:int,chance:double>>" if spans else ""
    return rows.mapInArrow(run, f"id {kind}, score double{more}").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield batch.filter(pa.array(model.scores(column_bytes(batch.column(at))) < threshold))

    return docs.mapInArrow(run, docs.schema)
