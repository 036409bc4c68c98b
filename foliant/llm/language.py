"""Language identification by error-correcting output codes.

Every language has a codeword; for each bit a logistic classifier over hashed byte n-grams of the whole text predicts
on which side the text's language stands. Decoding picks the codeword of least loss, each bit weighted by how well its
classifier did on rows kept back from training. The margin to the second codeword flags ambiguous texts.

Training takes at most ``PER_LANGUAGE`` rows of each of the ``LANGUAGES`` most frequent languages and ``ROWS`` of all, chosen
by the hash of their id; the driver gets their texts part by part and keeps features of a fixed size, 160 MB at most.
Null texts, and texts
without a letter, are ``und`` with score 0. Rows of null language are not learned from. With no language to learn from
every text is ``und``; with one, every text with a letter is that language. Repeated rows get equal results; further
columns are carried by no function here but ``predict``'s id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import thinned
from .words import FOLD, column_bytes, small

PER_LANGUAGE = 800
LANGUAGES = 400
#: Rows of all languages to learn from: 25 KB of features each.
ROWS = 6400
BUCKETS = 2048
DIM = 256 + 3 * BUCKETS
#: Least difference of two codewords' probabilities that counts as certain.
MARGIN = 0.1
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def features(text: bytes) -> np.ndarray:
    """Square roots of the shares of 1- to 4-byte sequences, hashed; unit length for each order."""
    b = FOLD[np.frombuffer(text, np.uint8)]
    out = np.zeros(DIM, np.float32)
    if not len(b):
        return out
    out[:256] = np.sqrt(np.bincount(b, minlength=256) / len(b))
    v, at = b.astype(np.uint32), 256
    for n in (2, 3, 4):
        if len(b) < n:
            break
        v = (v[:-1] << np.uint32(8)) | b[n - 1 :]
        h = (v * np.uint32(0x9E3779B1)) >> np.uint32(21)
        out[at : at + BUCKETS] = np.sqrt(np.bincount(h, minlength=BUCKETS) / len(h))
        at += BUCKETS
    return out


def has_letter(text: bytes) -> bool:
    if _LETTER[np.frombuffer(text, np.uint8)].any():
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace")) if text else False


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1: all two-part splits for up to 6 languages, else the best of seeded random codes."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        bits = np.array([[(k >> i) & 1 for k in range(1, 1 << (n - 1))] for i in range(n - 1)] + [[0] * ((1 << (n - 1)) - 1)])
        return (2 * bits - 1).astype(np.int8)
    rng, best, far = np.random.Generator(np.random.PCG64(n)), None, -1
    length = max(16, int(10 * np.ceil(np.log2(n))))
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (n, length))
        if (abs(code.sum(axis=0)) == n).any():
            continue
        alike = code.astype(np.int32) @ code.T.astype(np.int32)
        apart = int(length - (alike - 2 * length * np.eye(n, dtype=np.int32)).max()) // 2
        if apart > far:
            best, far = code, apart
    return best


def logistic_bits(x: np.ndarray, y: np.ndarray, steps: int = 120, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """One logistic classifier for each column of y (-1, 1), all trained together by Adam on the full sample."""
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        g = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) / len(x)
        for p, grad, a, s in ((w, x.T @ g + ridge * w, m, v), (b, g.sum(axis=0), mb, vb)):
            a += 0.1 * (grad - a)
            s += 0.01 * (grad * grad - s)
            p -= 0.3 * (a / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return w, b


class Model:
    def __init__(self, texts: Iterable[bytes], langs: list[str]):
        """texts may be features already."""
        self.langs = sorted(set(langs))
        self.code = codewords(len(self.langs))
        self.w = self.b = None
        if len(self.langs) < 2:
            return
        x = np.stack([features(t) if isinstance(t, bytes) else t for t in texts])
        y = self.code[[self.langs.index(k) for k in langs]].astype(np.float32)
        back = np.arange(len(x)) % 5 == 4
        if back.sum() < 5:
            back[:] = False
        self.w, self.b = logistic_bits(x[~back], y[~back])
        right = ((x[back] @ self.w + self.b) * y[back] > 0).mean(axis=0) if back.any() else np.ones(y.shape[1])
        right = np.clip(right, 0.5, 1 - 1e-3)
        self.weight = np.log(right / (1 - right)) + 1e-3
        self.weight = (self.weight / self.weight.sum()).astype(np.float32) * self.code.shape[1]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row of bit margins: the best codeword, its probability, and how far the second is below."""
        z = margins[:, None, :] * self.code[None].astype(np.float32)
        loss = (np.logaddexp(0, -z) * self.weight).sum(axis=2)
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        two = np.sort(p, axis=1)[:, -2:]
        return loss.argmin(axis=1), two[:, 1], two[:, 1] - two[:, 0]

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float], list[bool]]:
        lang, score, unsure = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
        rows = [i for i, t in enumerate(texts) if self.langs and has_letter(t)]
        if rows and self.w is None:
            for i in rows:
                lang[i], score[i] = self.langs[0], 1.0
        elif rows:
            best, p, margin = self.decode(np.stack([features(texts[i]) @ self.w + self.b for i in rows]))
            for i, k, s, d in zip(rows, best.tolist(), p.tolist(), margin.tolist(), strict=True):
                lang[i], score[i], unsure[i] = self.langs[k], min(1.0, s), d < MARGIN
        return lang, score, unsure


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = PER_LANGUAGE) -> Model:
    """Fits on at most about ``most`` rows of each language of the rows given; pass in the rows that may be learned from."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.col(lang_col).alias("y"))
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").limit(LANGUAGES).collect()}
    some = thinned(rows.where(F.col("y").isin(list(counts))), "k", "y", max(1, min(most, ROWS // max(1, len(counts)))), counts) if counts else rows.limit(0)
    got = [(str(r.k), r.y, features(r.t.encode())) for r in some.repartition(8).toLocalIterator()]
    got.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
    return Model([x for _, _, x in got], [y for _, y, _ in got])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, ambiguous) for every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            lang, score, unsure = model.predict(column_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], names=["id", "lang_pred", "score", "ambiguous"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", wanted: tuple[str, ...] | None = None) -> DataFrame:
    """The rows, with all their columns, whose text has a language for certain: ``und`` rows and ambiguous ones go, and
    those of languages that are not wanted (None: all that the model knows are)."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            lang, _, unsure = model.predict(column_bytes(batch.column(at)))
            yield batch.filter(pa.array([k != "und" and not u and (wanted is None or k in wanted) for k, u in zip(lang, unsure, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
