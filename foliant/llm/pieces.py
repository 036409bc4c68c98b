"""SentencePiece encoding and decoding by an Aho-Corasick automaton over the pieces.

The automaton reads the text once. At each position its output links list every piece that ends there, and each such
piece relaxes the best segmentation of the text up to there (a Viterbi pass):

* Unigram models: the best score is the largest sum of piece scores; unknown characters cost the least score less 10.
* BPE models: sums of scores do not give the merges' result, so the score is validity: a piece relaxes a position if
  it and the last piece of the prefix before it are what merging their joined text gives. Exactly one piece passes,
  the longest first, and the path of these pieces is the merges' own result (tested against the library on whole texts).

Words are encoded one by one where no piece reaches over a word's end, and remembered in a table of bounded size.
Characters that no piece covers become byte pieces where the model has them, else the unknown piece.

Null and empty texts have no pieces, and decode to the empty text. Repeated rows get equal results; null ids are kept.
The model's path is a parameter; it is read where the query is built.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Remembered, small

UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"
#: What the library's unigram models take off the least score for an unknown character (fixed value).
PENALTY = 10.0
REMEMBERED, LONGEST = 600_000, 64


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        shift = out = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[i : i + n]
            i += n


class Model:
    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, dummy_prefix: bool = True, squeeze: bool = False):
        self.pieces, self.kind, self.dummy_prefix, self.squeeze = pieces, kind, dummy_prefix, squeeze
        self._ready()

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        pieces, kind, dummy, squeeze, chars = [], UNIGRAM, True, True, b""
        for field, value in _fields(data):
            if field == 1:
                text, score, type_ = "", 0.0, NORMAL
                for f, v in _fields(value):
                    if f == 1:
                        text = v.decode()
                    elif f == 2:
                        score = struct.unpack("<f", v)[0]
                    elif f == 3:
                        type_ = v
                pieces.append((text, score, type_))
            elif field == 2:
                kind = next((v for f, v in _fields(value) if f == 3), UNIGRAM)
            elif field == 3:
                spec = dict(_fields(value))
                dummy, squeeze, chars = bool(spec.get(3, 1)), bool(spec.get(4, 1)), spec.get(2, b"")
                if not spec.get(5, 1):
                    raise ValueError("models that do not escape white space are not supported")
        if chars or kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models with identity normalization are supported")
        return cls(pieces, kind, dummy, squeeze)

    @classmethod
    def from_file(cls, path: str) -> Model:
        with open(path, "rb") as f:
            return cls.from_bytes(f.read())

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("pieces", "kind", "dummy_prefix", "squeeze")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._ready()

    def _ready(self) -> None:
        self.ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER_DEFINED, UNUSED)}
        self.worth = {p: s for p, s, t in self.pieces if t in (NORMAL, USER_DEFINED, UNUSED)}
        self.paths: dict[str, tuple] = {}  # of pieces, so as many at most
        self.unknown = next((i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN), 0)
        found = {int(p[1:-1], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.bytes = [found[b] for b in range(256)] if len(found) == 256 else None
        self.floor = min((s for _, s, t in self.pieces if t == NORMAL), default=0.0) - PENALTY
        self.shown: list[str | None] = []
        for p, _, t in self.pieces:
            code = int(p[1:-1], 16) if t == BYTE else 0
            self.shown.append((chr(code) if code < 128 else None) if t == BYTE else " ⁇ " if t == UNKNOWN else "" if t == CONTROL else p.replace(SPACE, " "))
        # breaks that no piece reaches over: before a space mark that follows another sign, and around line ends
        inner = any(SPACE in p.lstrip(SPACE) or ("\n" in p and p != "\n") for p in self.ids)
        self.split = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if not inner else r"(?s).+").findall
        self.known = Remembered(REMEMBERED)
        self.fits = Remembered(REMEMBERED)
        self.automaton = ahocorasick.Automaton()  # its matches at each position follow the output links
        for p in self.ids:
            if p:
                self.automaton.add_word(p, (p, len(p)))
        if self.ids:
            self.automaton.make_automaton()

    def _path(self, p: str) -> tuple[bool, list[float], list[str], list[str]]:
        """How merging makes p of its characters, the best-scored pair first and the leftmost of equals: whether it
        comes to p, the score of each merge, and the last and the first symbol before each merge and at the end."""
        found = self.paths.get(p)
        if found is None:
            symbols, scores, last, first = list(p), [], [p[-1]], [p[0]]
            while True:
                best, at = None, -1
                for i in range(len(symbols) - 1):
                    v = self.worth.get(symbols[i] + symbols[i + 1])
                    if v is not None and (best is None or v > best):
                        best, at = v, i
                if best is None:
                    break
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
                scores.append(best)
                last.append(symbols[-1])
                first.append(symbols[0])
            found = self.paths[p] = (len(symbols) == 1, scores, last, first)
        return found

    def _fit(self, a: str, b: str) -> bool:
        """Whether merging a + b gives a and b: no pair over the border is ever the best while each side is merged."""
        ok = self.fits.get((a, b))
        if ok is None:
            whole, x, last, _ = self._path(a)
            ok, y, _, first = self._path(b)
            ok = ok and whole
            i = j = 0
            while ok:
                over = self.worth.get(last[i] + first[j])
                if over is not None and (i == len(x) or over > x[i]) and (j == len(y) or over >= y[j]):
                    ok = False
                elif i == len(x) and j == len(y):
                    break
                elif j == len(y) or (i < len(x) and x[i] >= y[j]):
                    i += 1
                else:
                    j += 1
            self.fits.put((a, b), ok)
        return ok

    def segment(self, text: str) -> list[str]:
        """One pass of the automaton; last[i] is the last piece of the best segmentation of text[:i]."""
        n, at = len(text), 0
        last: list[str | None] = [""] + [None] * n
        best = [0.0] + [float("-inf")] * n
        merging, worth, ids, fits, paths = self.kind == BPE, self.worth, self.ids, self.fits.young, self.paths
        for end, (p, k) in self.automaton.iter(text):
            i = end + 1
            if i != at:  # the positions up to here have met all their pieces
                for m in range(at or 1, i):
                    if last[m] is None and text[m - 1] not in ids:
                        last[m], best[m] = text[m - 1], best[m - 1] + self.floor
                at = i
            elif merging and last[i] is not None:
                continue
            j = i - k
            q = last[j]
            if q is None:
                continue
            if merging:
                ok = fits.get((q, p)) if j else (paths.get(p) or self._path(p))[0]
                if ok is None:
                    ok = self._fit(q, p)
                    fits = self.fits.young
                if ok:
                    last[i] = p
            else:
                v = best[j] + worth[p]
                if v > best[i]:
                    best[i], last[i] = v, p
        for m in range(at or 1, n + 1):
            if last[m] is None and text[m - 1] not in ids:
                last[m], best[m] = text[m - 1], best[m - 1] + self.floor
        out, i = [], n
        while i:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]

    def _ids(self, word: str) -> list[int]:
        out: list[int] = []
        for p in self.segment(word):
            k = self.ids.get(p)
            if k is not None:
                out.append(k)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode()]
            elif not out or out[-1] != self.unknown or self.kind == BPE:
                out.append(self.unknown)
        return out

    def normalize(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)

    def packed(self, text: str | None) -> bytes:
        """The ids as native 32-bit integers; words are remembered in this form, which is small and holds no objects."""
        out: list[bytes] = []
        known = self.known
        for word in self.split(self.normalize(text or "")):
            ids = known.young.get(word) or known.get(word)
            if ids is None:
                ids = array("i", self._ids(word)).tobytes()
                if len(word) <= LONGEST:
                    known.put(word, ids)
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return memoryview(self.packed(text)).cast("i").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of the pieces; runs of byte pieces are read as UTF-8, with U+FFFD for each byte that is none."""
        try:
            text = "".join(map(self.shown.__getitem__, ids))
        except TypeError:  # bytes of characters beyond ASCII
            text = self._with_bytes(ids)
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def _with_bytes(self, ids: list[int]) -> str:
        out: list[str] = []
        run = bytearray()
        for i in [*ids, -1]:
            p, _, t = self.pieces[i] if i >= 0 else ("", 0.0, NORMAL)
            if t == BYTE:
                run.append(int(p[1:-1], 16))
                continue
            if run:
                out.append(self._utf8(bytes(run)))
                run.clear()
            if t == UNKNOWN:
                out.append(" ⁇ ")
            elif t != CONTROL:
                out.append(p)
        return "".join(out).replace(SPACE, " ")

    @staticmethod
    def _utf8(run: bytes) -> str:
        out, i = [], 0
        while i < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[i : i + n].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                n = 1
                out.append("�")
            i += n
        return "".join(out)


def encoded(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece_ids, n_pieces, round_trip) for every row; ``decoded`` turns piece_ids into texts again."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # as large as the vocabulary, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in small(batches):
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                texts = [t or "" for t in part.column("text").to_pylist()]
                packed = [m.packed(t) for t in texts]
                n = [len(k) // 4 for k in packed]
                same = [m.decode(memoryview(k).cast("i").tolist()) == t for k, t in zip(packed, texts, strict=True)]
                ids = pa.ListArray.from_arrays(pa.array([0, *accumulate(n)], pa.int32()), pa.Array.from_buffers(pa.int32(), sum(n), [None, pa.py_buffer(b"".join(packed))]))
                yield pa.RecordBatch.from_arrays([part.column("id"), ids.cast(pa.list_(pa.int32())), pa.array(n, pa.int64()), pa.array(same, pa.bool_())], names=["id", "piece_ids", "n_pieces", "round_trip"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, piece_ids array<int>, n_pieces long, round_trip boolean").withColumnRenamed("id", id_col)


def decoded(pieces: DataFrame, model: Model, id_col: str = "doc_id", ids_col: str = "piece_ids") -> DataFrame:
    """(id_col, text) for every row; null ids lists give null."""
    rows = pieces.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    sent = pieces.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in small(batches):
            texts = [None if k is None else m.decode(k) for k in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def report(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_pieces, ids_sha256 (of the ids as little-endian 32-bit integers), decoded_sha256, round_trip) for every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in small(batches):
            out: list[list] = [[], [], [], [], []]
            for t in batch.column("text").to_pylist():
                t = t or ""
                ids = m.packed(t)
                back = m.decode(memoryview(ids).cast("i").tolist())
                for column, v in zip(out, (len(t.encode()), len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == t), strict=True):
                    column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], names=["id", "n_bytes", "n_pieces", "ids_sha256", "decoded_sha256", "round_trip"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean").withColumnRenamed("id", id_col)
