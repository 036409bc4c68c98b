"""Benchmark decontamination by suffix arrays over the words of document shards.

Each shard, about ``SHARD`` bytes of whole documents, gets numbers for its words (0: a word that no item has) and an array
of its suffixes sorted by their first 8 words, by prefix doubling. Only suffixes that can match are in it: those inside a
run of benchmark words that is long enough for the shortest window. Every distinct window at which a test suffix begins
is binary-searched; windows of one length lie at different places, so a shard has at most as many hits as words for each
length, however often a window repeats on either side. Items come in afterwards, from a list for each window.

From hits the longest verbatim matches are read off a full suffix array of the items: going on word by word narrows the
range of test suffixes, until none is left; the next match begins at the first window that is not inside this one.

Words are numbered by a hash and then compared by their bytes. Benchmarks travel to the executors in blocks of about
``BLOCK_BYTES`` of text, dealt by the items' ids on the executors; the driver reads one block at a time, and each is a
pass over the documents. An item is never split: the bound of a block is that, or the longest item.

Null or empty texts have no words; such documents are clean, such items occur nowhere. Items of null id are ignored.
Repeated items with different ids each count; items that share an id count once, with the windows of all their texts.
Empty tables: an empty result, or all documents clean. Other columns are carried along by ``clean`` and ignored
elsewhere; the ids of items are compared as strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .store import Scratch, free
from .words import FOLD, LETTERS, Chunk, chunks, column_bytes, small

WINDOW = 8
BLOCK_BYTES = 8 << 20
SHARD = 1 << 20
#: Items in the rows that are sent on at once.
FLUSH = 100_000
FOUND = "n_words long, items array<string>, hits array<struct<start:int,length:int>>, spans array<struct<item:string,place:int,start:int,length:int>>"


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, .., of sizes[0] numbers, then those of first[1], ..."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(first, sizes)


class Index:
    """The suffixes of a block of benchmark items, of WINDOW words each (or the whole item, if shorter)."""

    def __init__(self, items: list[tuple[str, bytes]]):
        items = [(k, t) for k, t in sorted(items) if t]
        self.names = sorted({k for k, _ in items})
        owner = {k: n for n, k in enumerate(self.names)}
        parts = list(chunks([t for _, t in items], LETTERS))
        row = np.concatenate([c.first + c.row for c in parts]) if parts else np.empty(0, np.int64)
        self._vocabulary(parts)
        numbers = np.concatenate([self.number(c) for c in parts]) if parts else np.empty(0, np.int64)
        lengths = np.bincount(row, minlength=len(items))
        self._suffixes(numbers, lengths, np.array([owner[k] for k, _ in items], np.int64))
        sizes = np.minimum(lengths, WINDOW)
        #: (words of a window, distinct windows, number of the first)
        self.tests: list[tuple[int, np.ndarray, int]] = []
        pairs, total = [], 0
        for m in np.unique(sizes[sizes > 0]).tolist():
            at = np.flatnonzero(sizes == m)
            each = lengths[at] - m + 1
            place = ranges(self.first[at], each)
            windows, which = np.unique(np.stack([self.words[place + k] for k in range(m)], axis=1), axis=0, return_inverse=True)
            self.tests.append((m, windows, total))
            pairs.append((which.ravel() + total) * max(1, len(self.names)) + np.repeat(self.owner[at], each))
            total += len(windows)
        pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        self.posts = pairs % max(1, len(self.names))
        self.offsets = np.searchsorted(pairs // max(1, len(self.names)), np.arange(total + 1))
        self.shortest = min((t[0] for t in self.tests), default=0)

    def _vocabulary(self, parts: list[Chunk]) -> None:
        """The distinct words, by their hashes: numbers from 1, and their bytes."""
        found: dict[int, bytes] = {}
        for c in parts:
            h, at = np.unique(c.hashes(), return_index=True)
            lower = FOLD[c.bytes]
            for k, a, b in zip(h.tolist(), c.start[at].tolist(), c.end[at].tolist(), strict=True):
                w = lower[a:b].tobytes()
                if found.setdefault(k, w) != w:
                    raise ValueError(f"the words {found[k]!r} and {w!r} of the benchmark have one hash")
        self.hashes = np.array(sorted(found), np.uint64)
        texts = [found[int(h)] for h in self.hashes]
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def number(self, chunk: Chunk) -> np.ndarray:
        """For each word of the chunk its number, or 0 where no item has these very bytes."""
        out = np.zeros(len(chunk.start), np.int64)
        if not len(self.hashes) or not len(out):
            return out
        h = chunk.hashes()
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        size = chunk.end - chunk.start
        can = np.flatnonzero((self.hashes[at] == h) & (self.sizes[at] == size))
        if not len(can):
            return out
        n = size[can]
        same = FOLD[chunk.bytes[ranges(chunk.start[can], n)]] == self.bytes[ranges(self.starts[at[can]], n)]
        ok = np.logical_and.reduceat(same, np.cumsum(n) - n)
        out[can[ok]] = at[can[ok]] + 1
        return out

    def _suffixes(self, numbers: np.ndarray, lengths: np.ndarray, owner: np.ndarray) -> None:
        """All suffixes of the items in full order; each item ends in zeros, so that a suffix ends with its item."""
        self.owner, self.lengths = owner, lengths
        padded = lengths + WINDOW
        self.first = np.cumsum(padded) - padded
        self.words = np.zeros(int(padded.sum()) + 1, np.int64)
        at = ranges(self.first, lengths)
        self.words[at] = numbers
        self.item_of = np.repeat(np.arange(len(lengths)), padded)
        rank, span = self.words, 1
        while len(at):
            both = rank[at] * (len(at) + len(self.hashes) + 2) + np.where(at + span < len(rank), rank[np.minimum(at + span, len(rank) - 1)], 0)
            _, dense = np.unique(both, return_inverse=True)
            new = np.zeros(len(rank), np.int64)
            new[at] = dense.ravel() + 1
            rank, span = new, span * 2
            if int(rank.max()) == len(at) or span >= int(lengths.max()):
                break
        self.array = at[np.argsort(rank[at], kind="stable")]

    def longest(self, words: np.ndarray, p: int) -> tuple[int, int, int]:
        """The longest match of the words from p on: (item, place in the item, words)."""
        lo, hi, d = 0, len(self.array), 0
        while True:
            if hi - lo == 1:
                # one suffix is left: compare on to the first difference
                b, step = int(self.array[lo]), 64
                while n := min(step, len(words) - p - d, len(self.words) - b - d):
                    x, y = words[p + d : p + d + n], self.words[b + d : b + d + n]
                    differ = np.flatnonzero((x != y) | (x == 0))
                    if len(differ):
                        d += int(differ[0])
                        break
                    d, step = d + n, step * 2
                break
            w = int(words[p + d]) if p + d < len(words) else 0
            if not w:
                break
            if self.words[self.array[lo] + d] == w == self.words[self.array[hi - 1] + d]:
                d += 1
                continue
            low, high = self._bound(lo, hi, d, w), self._bound(lo, hi, d, w + 1)
            if low == high:
                break
            lo, hi, d = low, high, d + 1
        at = self.array[lo:hi]
        items = self.item_of[at]
        k = int(np.lexsort((at, self.owner[items]))[0]) if hi - lo > 1 else 0
        return int(self.owner[items[k]]), int(at[k] - self.first[items[k]]), d

    def _bound(self, lo: int, hi: int, d: int, w: int) -> int:
        while lo < hi:
            mid = (lo + hi) // 2
            if self.words[self.array[mid] + d] < w:
                lo = mid + 1
            else:
                hi = mid
        return lo


def suffix_array(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The places sorted by the WINDOW words from there on, by prefix doubling.

    words ends in at least WINDOW zeros, and a zero word ends whatever stands before it. Ranks are made for all words
    that a place's window reaches, as the second half of a longer prefix begins at a word that may be no place itself.
    """
    n = len(words)
    reach = np.zeros(n + WINDOW, np.int64)
    np.add.at(reach, places, 1)
    np.add.at(reach, places + WINDOW, -1)
    live = np.flatnonzero((np.cumsum(reach)[:n] > 0) & (words > 0))
    rank, span = words, 1
    while span < WINDOW:
        both = rank[live] * (int(rank.max(initial=0)) + 1) + rank[np.minimum(live + span, n - 1)]
        _, dense = np.unique(both, return_inverse=True)
        rank = np.zeros(n, np.int64)
        rank[live] = dense + 1
        span *= 2
    return places[np.argsort(rank[places], kind="stable")]


def search(words: np.ndarray, array: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of the suffix array whose suffixes begin with each query, by binary search on all queries at once."""

    def bound(right: bool) -> np.ndarray:
        lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(array), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            at = array[np.minimum(mid, len(array) - 1)]
            less, same = np.zeros(len(queries), bool), np.ones(len(queries), bool)
            for k in range(queries.shape[1]):
                w = words[at + k]
                less |= same & (w < queries[:, k])
                same &= w == queries[:, k]
            go = open_ & (less | (same & right))
            lo = np.where(go, mid + 1, lo)
            hi = np.where(open_ & ~go, mid, hi)
        return lo

    return bound(False), bound(True)


class Hits:
    """Where windows of the index occur in a chunk: for each hit its row, place in the row, words, and window."""

    def __init__(self, chunk: Chunk, index: Index):
        self.chunk, self.index = chunk, index
        self.row = self.place = self.size = self.window = np.empty(0, np.int64)
        if not len(chunk.start) or not index.tests:
            return
        own = index.number(chunk)
        # texts are set apart by zeros, so that no window crosses from one into the next
        words = np.zeros(len(own) + (len(chunk.texts) + 1) * WINDOW, np.int64)
        at = np.arange(len(own)) + chunk.row * WINDOW
        words[at] = own
        self.words, self.at = words, at
        zero = np.flatnonzero(words == 0)
        places = at[zero[np.searchsorted(zero, at)] - at >= index.shortest]
        if not len(places):
            return
        array = suffix_array(words, places)
        present = np.zeros(len(index.hashes) + 1, bool)
        present[own] = True
        found: list[tuple[np.ndarray, ...]] = []
        for m, windows, first in index.tests:
            could = np.flatnonzero(present[windows].all(axis=1))
            lo, hi = search(words, array, windows[could])
            n = hi - lo
            p = array[ranges(lo, n)]
            found.append((p, np.full(len(p), m), np.repeat(could + first, n)))
        p, self.size, self.window = (np.concatenate([f[k] for f in found]) for k in range(3))
        k = np.searchsorted(at, p)  # back from padded places to words of the row
        self.row = chunk.row[k]
        self.place = k - chunk.offset[self.row]
        order = np.lexsort((-self.size, self.place, self.row))
        self.row, self.place, self.size, self.window = (x[order] for x in (self.row, self.place, self.size, self.window))

    def windows(self) -> Iterator[tuple[int, np.ndarray]]:
        """(row, its distinct windows) for each row with hits."""
        if len(self.row):
            total = int(self.window.max()) + 1
            both = np.unique(self.row * total + self.window)
            rows = both // total
            cuts = [0, *(np.flatnonzero(rows[1:] != rows[:-1]) + 1).tolist(), len(both)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield int(rows[a]), both[a:b] % total

    def items(self, windows: np.ndarray) -> np.ndarray:
        """The numbers of the items that any of the windows is of."""
        i = self.index
        return np.unique(i.posts[ranges(i.offsets[windows], i.offsets[windows + 1] - i.offsets[windows])])

    def covered(self) -> Iterator[tuple[int, int, int]]:
        """(row, first word, words) of each stretch of hit words."""
        end = self.place + self.size
        if not len(end):
            return
        # rows are set apart, so that the furthest end so far never reaches into the next row
        far = int(end.max()) + 1
        reach = np.maximum.accumulate(end + self.row * far)
        new = np.ones(len(end), bool)
        new[1:] = self.place[1:] + self.row[1:] * far > reach[:-1]
        new[1:] |= self.row[1:] != self.row[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(end)) - 1
        yield from zip(self.row[first].tolist(), self.place[first].tolist(), (reach[last] - self.row[first] * far - self.place[first]).tolist(), strict=True)

    def matches(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, place in it, first word, words) of longest verbatim matches, which cover all hits."""
        row, upto = -1, 0
        for r, p, m in zip(self.row.tolist(), self.place.tolist(), self.size.tolist(), strict=True):
            if r != row:
                row, upto = r, 0
            if p + m <= upto:
                continue
            if m == WINDOW:
                item, place, n = self.index.longest(self.words, int(self.at[self.chunk.offset[r] + p]))
            else:
                k = int(self.at[self.chunk.offset[r] + p])
                item, place, n = self._short(k, m)
            upto = max(upto, p + n)
            yield r, item, place, p, n

    def _short(self, k: int, m: int) -> tuple[int, int, int]:
        """An item of fewer words than a window, as a whole."""
        windows, first = next((w, f) for size, w, f in self.index.tests if size == m)
        at = first + int(np.flatnonzero((windows == self.words[k : k + m]).all(axis=1))[0])
        return int(self.index.posts[self.index.offsets[at]]), 0, m


def _find(index: Index, more: bool):
    """One pass over (id, text) or, from the second block on, (id, text, n_words, items, hits, spans); more: another pass
    will follow, which needs the texts."""
    span = pa.struct([("item", pa.string()), ("place", pa.int32()), ("start", pa.int32()), ("length", pa.int32())])
    kinds = {"n_words": pa.int64(), "items": pa.list_(pa.string()), "hits": pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])), "spans": pa.list_(span)}
    last: dict[bytes, list[str]] = {}

    def names(hits: Hits, windows: np.ndarray) -> list[str]:
        key = windows.tobytes()
        if key not in last:
            last.clear()  # passages come in groups; one list is kept
            last[key] = [index.names[k] for k in hits.items(windows).tolist()]
        return last[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            first, held = 0, []
            before = {k: batch.column(k).to_pylist() for k in kinds} if "n_words" in batch.schema.names else None

            def flush(upto: int) -> pa.RecordBatch:
                own = {"id": batch.column("id").slice(first, upto - first)} | ({"text": batch.column("text").slice(first, upto - first)} if more else {})  # noqa: B023
                own |= {k: pa.array([r[k] for r in held], kind) for k, kind in kinds.items()}  # noqa: B023
                return pa.RecordBatch.from_arrays(list(own.values()), names=list(own))

            size, row = 0, 0
            for c in chunks(column_bytes(batch.column("text")), LETTERS, most=SHARD):
                hits = Hits(c, index)
                items = {r: names(hits, w) for r, w in hits.windows()} if len(hits.row) < FLUSH else None
                windows = dict(hits.windows()) if items is None else {}
                stretches: dict[int, list] = {}
                for r, p, n in hits.covered():
                    stretches.setdefault(r, []).append({"start": p, "length": n})
                spans: dict[int, list] = {}
                for r, item, place, p, n in hits.matches():
                    spans.setdefault(r, []).append({"item": index.names[item], "place": place, "start": p, "length": n})
                for r, n in enumerate(np.diff(c.offset).tolist()):
                    got = items.get(r, []) if items is not None else names(hits, windows[r]) if r in windows else []
                    new = {"n_words": n, "items": got, "hits": stretches.get(r, []), "spans": spans.get(r, [])}
                    held.append(new if before is None else joined({k: before[k][row] for k in kinds}, new))
                    size, row = size + len(got), row + 1
                    if size >= FLUSH:
                        yield flush(row)
                        first, held, size = row, [], 0
            if held:
                yield flush(row)

    return run


def joined(a: dict, b: dict) -> dict:
    """What two blocks of the benchmark found in one document."""
    hits: list[dict] = []
    for h in sorted(a["hits"] + b["hits"], key=lambda h: (h["start"], h["length"])):
        end = hits[-1]["start"] + hits[-1]["length"] if hits else -1
        if h["start"] <= end:
            hits[-1]["length"] = max(end, h["start"] + h["length"]) - hits[-1]["start"]
        else:
            hits.append(dict(h))
    spans = sorted(a["spans"] + b["spans"], key=lambda s: (s["start"], -s["length"], s["item"]))
    return {"n_words": b["n_words"], "items": sorted({*a["items"], *b["items"]}), "hits": hits, "spans": spans}


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[Index, bool]]:
    """(index, whether more follow) of each block of the benchmark. Blocks are dealt by the items' ids and written by the
    executors; the driver holds one at a time."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("k"), F.col(text_col).cast("binary").alias("t")).where("k is not null and octet_length(t) > 0")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    read = lambda df: Index([(r.k, bytes(r.t)) for r in df.select("k", "t").toLocalIterator()])
    if n == 1:
        yield read(rows), False
        return
    scratch = Scratch(benchmark.sparkSession, "benchmark")
    dealt = scratch.table(rows.withColumn("block", F.pmod(F.xxhash64("k"), F.lit(n)).cast("int")).repartition(n, "block").sortWithinPartitions("block"))
    for k in range(n):
        yield read(dealt.where(F.col("block") == k)), k + 1 < n
    scratch.clear()


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each row of docs: id_col, n_words, items (the ids of items with a window in it, sorted), hits (stretches of hit
    words: first word, words) and spans (longest verbatim matches: the least item that has it, its place there, first
    word, words).

    A computed column that would have the id column's name gets underscores after it.
    """
    done = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = done.schema["id"].dataType.simpleString()
    scratch = None
    for index, more in blocks_of(benchmark, item_col, item_text):
        done = done.mapInArrow(_find(index, more), f"id {id_type}, {'text string, ' if more else ''}{FOUND}")
        if more:  # written, so that the driver need not hold this block any longer
            scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
            done = scratch.table(done)
    names = [free(f.name, (id_col,)) for f in done.schema.fields[1:]]
    return done.toDF(id_col, *names)


def report(found: DataFrame, id_col: str = "doc_id", least_items: int = 2) -> DataFrame:
    """Digest of ``matches``: n_words, n_hit, n_items, items_sha256, contaminated (n_items >= least_items)."""
    return found.select(
        F.col(id_col),
        F.col("n_words"),
        F.expr("aggregate(hits, 0L, (n, h) -> n + h.length)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") >= least_items).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, least_items: int = 1, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows, with all their columns, in which windows of fewer than ``least_items`` items occur.

    With several blocks of items, the number found so far goes along in a column of a name that docs does not have.
    """
    at, kind, count = docs.columns.index(text_col), docs.schema, free("_items", docs.columns)

    def items(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small(batches):
                n = np.zeros(batch.num_rows, np.int64)
                for c in chunks(column_bytes(batch.column(at)), LETTERS, most=SHARD):
                    hits = Hits(c, index)
                    for r, windows in hits.windows():
                        n[c.first + r] = len(hits.items(windows))
                if batch.num_columns > len(kind):
                    n = n + batch.column(len(kind)).to_numpy()
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kind)], pa.array(n, pa.int64())], names=[*kind.names, count])

        return run

    out, scratch = docs, None
    for index, more in blocks_of(benchmark, item_col, item_text):
        out = out.mapInArrow(items(index), StructType([*kind.fields, StructField(count, LongType())]))
        if more:
            scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
            out = scratch.table(out)
    return out.where(F.col(count) < least_items).drop(count)
