"""Token counts of byte-level byte-pair encoding, without making the tokens.

A text is cut by the vocabulary's pattern into pieces, as its library does; special strings count as one token. Inside
a piece the symbols form a linked list, and a heap gives the adjacent pair of lowest rank: each pair popped and still
there is merged. The piece's count is its symbols at first less the merges. Counts of pieces are remembered in a
table of bounded size.

Null and empty texts have no tokens. Repeated rows get equal counts; null ids are kept. The vocabulary's path is a
parameter: a file in the JSON form of the ``tokenizers`` library with a byte-level pre-tokenizer, readable where the
query is built; the merges travel to the executors.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Remembered, small

LIMIT = 1024
#: The pieces of a byte-level pre-tokenizer with its own pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces remembered at most, and the longest that is.
REMEMBERED, LONGEST = 1_000_000, 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, k = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + k)
            k += 1
    return [out[b] for b in range(256)]


class Counts:
    def __init__(self, merges: list[tuple[str, str]], specials: list[str]):
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self._ready()

    def _ready(self) -> None:
        self.pattern = regex.compile(PATTERN)
        self.symbols = byte_symbols()
        self.known = Remembered(REMEMBERED)

    def __getstate__(self):
        return {"rank": self.rank, "special": self.special}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._ready()

    @classmethod
    def from_file(cls, path: str) -> Counts:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec.get("normalizer") or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path}: only byte-level BPE without normalizer or prefix space is supported")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        return cls(merges, [t["content"] for t in spec.get("added_tokens", [])])

    def piece(self, piece: str) -> int:
        s: list[str | None] = [self.symbols[b] for b in piece.encode()]
        n = count = len(s)
        rank = self.rank
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((s[i], s[i + 1]))) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if s[i] is None or j < 0 or rank.get((s[i], s[j])) != r:
                continue  # one of the two has been merged meanwhile
            s[i], s[j] = s[i] + s[j], None
            count -= 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (q := rank.get((s[i], s[k]))) is not None:
                    heapq.heappush(heap, (q, i))
            h = before[i]
            if h >= 0 and (q := rank.get((s[h], s[i]))) is not None:
                heapq.heappush(heap, (q, h))
        return count

    def _plain(self, text: str) -> int:
        total, known = 0, self.known
        for piece, times in Counter(self.pattern.findall(text)).items():
            n = known.get(piece)
            if n is None:
                n = self.piece(piece)
                if len(piece) <= LONGEST:
                    known.put(piece, n)
            total += n * times
        return total

    def text(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        at = total = 0
        for m in self.special.finditer(text):
            total += self._plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self._plain(text[at:])


def token_counts(docs: DataFrame, counts: Counts, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(counts)  # as large as the vocabulary, whatever the input

    kind = rows.schema["id"].dataType.simpleString()
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")

    def with_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = sent.value.text
        for batch in small(batches):
            n = [count(t) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    out = rows.withColumn("n_bytes", size).mapInArrow(with_size, f"id {kind}, n_bytes long, n_tokens long")
    return out.withColumnRenamed("id", id_col).withColumn("over_limit", F.col("n_tokens") > limit)
