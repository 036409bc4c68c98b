"""MinHash near-duplicates: banded candidates, sequential Bayesian pruning of signatures, exact verification.

Rows come as (id, text), ids as integers (others raise TypeError). A set is the distinct 5-word shingles of the whole
lower-cased text. Steps:

1. ``sketch``: for each row the set's size, a digest of the set, 32 band keys of 4 MinHash values each, and a
   signature of 128 further one-byte MinHash values (independent of the bands, so that a pair's meeting in a band
   does not bias its estimate). Rows of equal digest form a class, whose least id stands for it from here on.
2. Star candidates: in each bucket every member is paired with the bucket's least id only, never all with all.
3. Pairs are pruned batch by batch: once the posterior chance of a similarity at or over the threshold falls below
   ``MISS``, the pair is dropped. ``MISS`` holds for each of the four looks; over all of them a pair at exactly the
   threshold is dropped with a chance of 4.6e-6 (``total_miss``). Survivors are verified on their full sets: by
   hashes, and what these would link by the words themselves (``confirmed``).
4. Components of the verified links. Buckets that hold one component only are done. In others, the members outside
   the largest component are held against all members of other components, in blocks, by the same pruning, and the
   survivors verified block by block; only links come out.

Copies beyond one and pairs inside a component are thus never spelled out, yet no candidate link between two
components goes untested. A pair at the threshold meets in no band with a chance of (1 - 0.75^4)^32 = 5.2e-6.

Rows that share an id but not a text are rows of their own, with a set and a component each; where such an id stands for
several classes, a link of one is a link of all. Null ids: the row is kept with n_shingles and a null component, kept false. Null, empty or wordless texts: an empty
set, linked with nothing. Repeated rows: one class. An empty table gives an empty result. Columns other than id and
text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import Scratch, free, join_by_key
from .words import NOT_SPACE, chunks, column_bytes, mix, small

WORDS, BANDS, ROWS, VERIFY, BATCH = 5, 32, 4, 128, 32
PERCENT, MISS = 75, 1e-6
#: Members of a bucket that one block holds against another block.
BLOCK = 256

_rng = np.random.Generator(np.random.PCG64(75))
_SEEDS = _rng.integers(0, 1 << 32, BANDS * ROWS + VERIFY, dtype=np.uint32)
_FACTORS = _rng.integers(0, 1 << 32, BANDS * ROWS + VERIFY, dtype=np.uint32) | np.uint32(1)
_MULTIPLIERS = _rng.integers(1 << 62, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_BAND_MULTIPLIERS = _rng.integers(1 << 62, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles."""
    for c in chunks(texts, NOT_SPACE):
        h = c.hashes()
        if len(h) >= WORDS:
            run = sum(h[i : len(h) - WORDS + 1 + i] * _MULTIPLIERS[i] for i in range(WORDS))
            run = mix(run)
        for a, b in zip(c.offset[:-1].tolist(), c.offset[1:].tolist(), strict=True):
            if b - a >= WORDS:
                yield np.unique(run[a : b - WORDS + 1])
            elif b > a:
                short = (h[a:b] * _MULTIPLIERS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mix(np.array([short], np.uint64))
            else:
                yield np.empty(0, np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The least value of each seeded permutation, over blocks that stay in the CPU's cache."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(_SEEDS), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        v = x[None, i : i + 256] ^ _SEEDS[:, None]
        v *= _FACTORS[:, None]
        np.minimum(best, v.min(axis=1), out=best)
    return best


def band_keys(values: np.ndarray) -> np.ndarray:
    v = values[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    return mix((v * _BAND_MULTIPLIERS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def signature(values: np.ndarray) -> bytes:
    return (values[BANDS * ROWS :] & np.uint32(255)).astype(np.uint8).tobytes()


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def posterior(matches: int, n: int, threshold: float) -> float:
    """P(similarity >= threshold | matches of n), uniform prior: a beta tail, as a binomial sum."""
    return sum(comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(matches + 1))


def least_matches(miss: float = MISS, threshold: float = PERCENT / 100) -> np.ndarray:
    """For each number of compared batches, the least matches with which a pair goes on."""
    out = []
    for n in range(BATCH, VERIFY + 1, BATCH):
        out.append(next(m for m in range(n + 1) if posterior(m, n, threshold) >= miss))
    return np.array(out)


LEAST = least_matches()


def total_miss(least: np.ndarray = LEAST, similarity: float = PERCENT / 100) -> float:
    """P(a pair of this similarity is dropped at any look), from the distribution of its matches so far."""
    look = np.array([comb(BATCH, k) * similarity**k * (1 - similarity) ** (BATCH - k) for k in range(BATCH + 1)])
    got, lost = np.ones(1), 0.0
    for m in least:
        got = np.convolve(got, look)
        lost += got[:m].sum()
        got[:m] = 0
    return float(lost)


def surviving(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the rows whose signatures, compared batch by batch, are never pruned, and their matches."""
    alive = np.arange(len(left))
    got = np.zeros(len(left), np.int64)
    for k, least in enumerate(LEAST):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        got = got + (left[alive, cut] == right[alive, cut]).sum(axis=1)
        ok = got >= least
        alive, got = alive[ok], got[ok]
    return alive, got


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        n, digests, bands, sigs = [], [], [], []
        marks = ["null" if t is None else hashlib.md5(t, usedforsecurity=False).hexdigest() for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
        for s in shingle_sets(column_bytes(batch.column(1))):
            n.append(len(s))
            digests.append(digest(s) if len(s) else None)
            v = minhash(s) if len(s) else None
            bands.append(None if v is None else band_keys(v))
            sigs.append(None if v is None else signature(v))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(marks), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
            names=["id", "mark", "n_shingles", "digest", "bands", "sig"],
        )


def sketch(rows: DataFrame) -> DataFrame:
    return rows.select("id", "text").mapInArrow(_sketch, "id long, mark string, n_shingles long, digest binary, bands array<long>, sig binary")


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, VERIFY)


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        if batch.num_rows:
            keep, got = surviving(_signatures(batch.column(2)), _signatures(batch.column(3)))
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(got)], names=["a", "b", "matches"])


def confirmed(a: bytes, b: bytes) -> bool:
    """``linked`` on the words themselves, without any hash: words are numbered, shingles are numbers in that base."""
    number: dict[bytes, int] = {}
    ids = [np.fromiter((number.setdefault(w, len(number)) for w in t.lower().split()), np.int64) for t in (a, b)]
    n = [max(0, len(x) - WORDS + 1) for x in ids]
    if not n[0] or not n[1]:
        return len(ids[0]) > 0 and np.array_equal(*ids)
    base = len(number)
    key, bound = np.concatenate([x[:k] for x, k in zip(ids, n, strict=True)]), base
    for at in range(1, WORDS):
        if bound * base >= 1 << 62:
            _, key = np.unique(key, return_inverse=True)
            bound = int(key.max()) + 1
        key = key * base + np.concatenate([x[at : at + k] for x, k in zip(ids, n, strict=True)])
        bound *= base
    return linked(np.unique(key[: n[0]]), np.unique(key[n[0] :]))


def _verify_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (head, chunk): the head (side 0) before its members (side 1)."""
    now, text, own = None, b"", np.empty(0, np.uint64)
    for batch in small(batches):
        if not batch.num_rows:
            continue
        side, i = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        texts = column_bytes(batch.column(4))
        sets = shingle_sets(texts)
        a, b = [], []
        for key, lo, hi in _groups(batch, 2):
            if now != key:
                now, text, own = key, b"", own[:0]
            for k in range(lo, hi):
                s = next(sets)
                if side[k] == 0:
                    text, own = texts[k], s
                elif linked(own, s) and confirmed(text, texts[k]):
                    a.append(key[0])
                    b.append(int(i[k]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. texts: one row (id, text) for each representative.

    A head ``a`` travels once with every ``BLOCK`` or so of its members, never once for each pair.
    """
    chunks_ = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("chunks", F.ceil(F.col("n") / BLOCK).cast("int"))
    heads = chunks_.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), F.col("a").alias("id"))
    members = join_by_key(pairs, chunks_, "a", "n", pairs.count()).select("a", F.pmod(F.xxhash64("b"), "chunks").cast("int").alias("chunk"), F.lit(1).alias("side"), F.col("b").alias("id"))
    rows = heads.unionByName(members).join(texts, "id").select("a", "chunk", "side", "id", "text")
    return rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "side").mapInArrow(_verify_stars, "a long, b long")


def _groups(batch: pa.RecordBatch, by: int) -> Iterator[tuple[tuple, int, int]]:
    """(key, first, last) of each run of rows that agree in the first ``by`` columns."""
    key = np.stack([batch.column(k).to_numpy() for k in range(by)])
    cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield tuple(key[:, lo].tolist()), lo, hi


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks come sorted by (main, key, i, j): queries (side 0) before the members (side 1) they are held against.

    Gives for each query and block of members those that survive, in one row.
    """
    now, ids, comps, sigs = None, np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, VERIFY), np.uint8)
    for batch in batches:
        if not batch.num_rows:
            continue
        side, i, c = (batch.column(k).to_numpy() for k in (4, 5, 6))
        s = _signatures(batch.column(7))
        out: tuple[list, ...] = ([], [], [], [])
        for key, lo, hi in _groups(batch, 4):
            if now != key:
                now, ids, comps, sigs = key, i[:0], c[:0], s[:0]
            q = slice(lo, lo + int((side[lo:hi] == 0).sum()))
            ids, comps, sigs = np.concatenate((ids, i[q])), np.concatenate((comps, c[q])), np.concatenate((sigs, s[q]))
            m = slice(q.stop, hi)
            for k in range(len(ids)):
                # two queries meet from both sides; the lesser id keeps the pair
                other = np.flatnonzero((c[m] != comps[k]) & ((c[m] == key[0]) | (i[m] > ids[k])))
                keep, _ = surviving(np.broadcast_to(sigs[k], (len(other), VERIFY)), s[m][other])
                if len(keep):
                    for column, v in zip(out, (key[0], key[3], ids[k], i[m][other[keep]]), strict=True):
                        column.append(v)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.int64()))], names=["main", "j", "id", "partners"])


def _verify_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks come sorted by (main, j, chunk): members (side 0) before the queries (side 1) and their partners.

    A query's further partners in a component that it is linked with already need no test.
    """
    now, sets, comps, texts = None, {}, {}, {}
    for batch in batches:
        if not batch.num_rows:
            continue
        side, i, c = (batch.column(k).to_numpy() for k in (3, 4, 5))
        partners = batch.column(7)
        a, b = [], []
        for key, lo, hi in _groups(batch, 3):
            if now != key:
                now, sets, comps, texts = key, {}, {}, {}
            for k in range(lo, hi):
                (text,) = column_bytes(batch.column(6).slice(k, 1))
                (own,) = shingle_sets([text])
                if side[k] == 0:
                    sets[int(i[k])], comps[int(i[k])], texts[int(i[k])] = own, int(c[k]), text
                    continue
                done = set()
                for p in partners[k].as_py():
                    if p in sets and comps[p] not in done and linked(own, sets[p]) and confirmed(text, texts[p]):
                        done.add(comps[p])
                        a.append(min(p, int(i[k])))
                        b.append(max(p, int(i[k])))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _cross_links(buckets: DataFrame, reps: DataFrame, comp: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Verified links between different components that share a bucket: every pair is held against each other in
    blocks, survivors are listed by query and block, and verified where a block's texts are at hand; pairs do not
    become rows."""
    x = buckets.where("n > 2").join(comp, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    x = scratch.table(x)
    per = x.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("comps"), F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("top"))
    per = scratch.table(per.select("key", "comps", "all", F.col("top.comp").alias("main"), (F.col("all") - F.col("top.n")).alias("minor")))
    x = scratch.table(join_by_key(x, per, "key", "all", x.count(), of=F.col("comps") > 1).select("key", "id", "comp", "main", "minor"))
    # members are dealt over blocks by the buckets' main component, so that a block is the same in all its buckets
    dealt = scratch.table(x.groupBy("main", "id", "comp").agg(F.lit(1).alias("one")).drop("one"))
    size = dealt.groupBy("main").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.ceil(F.count_if(F.col("comp") != F.col("main")) / (4 * BLOCK)).cast("int").alias("chunks"))
    size, total = scratch.table(size), dealt.count()
    # a main component may hold most of the rows
    sized = lambda rows: join_by_key(rows, size, "main", "n", total)
    spread = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int")
    y = sized(x).join(reps.select("id", "sig"), "id")
    parts = F.ceil(F.col("minor") / BLOCK).cast("int")
    queries = y.where("comp <> main").select("main", "key", spread(parts, 1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side"), "id", "comp", "sig")
    members = y.select("main", "key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("i"), spread(F.col("blocks"), 2).alias("j"), F.lit(1).alias("side"), "id", "comp", "sig")
    blocks = queries.unionByName(members).repartition("key", "i", "j").sortWithinPartitions("main", "key", "i", "j", "side")
    found = blocks.mapInArrow(_cross, "main long, j int, id long, partners array<long>")
    found = scratch.table(found.groupBy("main", "j", "id").agg(F.array_distinct(F.flatten(F.collect_list("partners"))).alias("partners")))
    if found.isEmpty():
        return found.select(F.col("id").alias("a"), F.col("id").alias("b"))
    place = sized(dealt).select("main", "id", "comp", "chunks", spread(F.col("blocks"), 2).alias("j"))
    place = place.join(found.select("main", "j").distinct(), ["main", "j"], "left_semi")
    none = F.lit(None).cast("array<long>")
    members = place.select("main", "j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), "id", "comp", none.alias("partners"))
    queries = sized(found).select("main", "j", spread(F.col("chunks"), 3).alias("chunk"), F.lit(1).alias("side"), "id", F.lit(0).cast("long").alias("comp"), "partners")
    rows = members.unionByName(queries).join(texts, "id").select("main", "j", "chunk", "side", "id", "comp", "text", "partners")
    rows = rows.repartition("main", "j", "chunk").sortWithinPartitions("main", "j", "chunk", "side")
    return scratch.table(rows.mapInArrow(_verify_blocks, "a long, b long").distinct())


def _of_text(text_col: str):
    """A text's own mark, by which rows that share an id are told apart; null and empty texts differ."""
    return F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("null"))


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, n_shingles, component_id, n_copies, kept) for every row."""
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long", "void"):
        raise TypeError(f"ids must be integers; {id_col!r} is {docs.schema[id_col].dataType.simpleString()}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sk = scratch.table(sketch(rows))
    total = sk.count()
    classes = scratch.table(sk.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("n_copies")))
    reps = scratch.table(sk.where("digest is not null").join(classes, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]).select("id", "digest", "bands", "sig"))
    keyed = reps.select("id", F.explode("bands").alias("key"))
    heads = scratch.table(keyed.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("n")))
    buckets = scratch.table(join_by_key(keyed, heads.where("n > 1"), "key", "n", BANDS * total).select("key", "id", "head", "n"))
    pairs = buckets.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    pairs = scratch.table(pairs)
    stars = scratch.table(pairs.groupBy("a").agg(F.count("*").alias("n")).join(reps.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a"))
    pairs = join_by_key(pairs, stars, "a", "n", pairs.count()).join(reps.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    pairs = scratch.table(pairs.select("a", "b", "sa", "sb").mapInArrow(_prune, "a long, b long, matches long").select("a", "b").distinct())
    # the texts that verification can ask for are fetched once, by a join that is the same at every size
    asked = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(buckets.where("n > 2").select("id")).distinct()
    texts = scratch.table(rows.where("id is not null").hint("merge").join(asked, "id", "left_semi"))
    links = scratch.table(verified(pairs, texts).distinct())
    comp = components(links, scratch)
    more = _cross_links(buckets, reps, comp, texts, scratch)
    if not more.isEmpty():
        comp = components(links.unionByName(more), scratch)
    of_class = scratch.table(classes.join(comp, "id", "left").select("digest", "n_copies", F.coalesce("comp", "id").alias("comp")))
    scratch.clear(sk, of_class)
    out = sk.select("id", "mark", "n_shingles", "digest")
    # rows without a set have no class; they are not dealt out by the key that they lack
    out = join_by_key(out.where("digest is not null"), of_class, "digest", "n_copies", total, "left").unionByName(out.where("digest is null"), allowMissingColumns=True)
    out = out.select("id", "mark", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("comp", "id")).alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id, kept, n_copies (rows that have an id and the same set).

    A column of these that would have the id column's name gets underscores after it.
    """
    out = _judged(docs, id_col, text_col)
    names = [free(n, (id_col,)) for n in ("n_shingles", "component_id", "n_copies", "kept")]
    return out.select(F.col("id").alias(id_col), *(F.col(n.rstrip("_")).alias(n) for n in names))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that stand for their group; of rows with equal id and text one stays.

    Rows that share an id but not a text are judged one by one. Rows of null id belong to no group and stay. Documents
    are dealt out once, by id and the mark of their text; the text itself is no key.
    """
    name, mark = free("_kept", docs.columns), free("_mark", docs.columns)
    kept = _judged(docs, id_col, text_col).where("kept").select(F.col("id").alias(name), F.col("mark").alias(mark)).distinct()
    named = docs.where(F.col(id_col).isNotNull()).withColumn(mark, _of_text(text_col))
    named = named.join(kept.hint("merge"), (named[id_col] == kept[name]) & (named[mark] == kept[mark]), "left_semi").dropDuplicates([id_col, mark]).drop(mark)
    return named.unionByName(docs.where(F.col(id_col).isNull()))
