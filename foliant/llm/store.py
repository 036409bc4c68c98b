"""Intermediate tables that every executor can read, and bounded samples of labelled rows."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    return found.rstrip("/") if found else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_foliant"


_collecting: list[list[Scratch]] = []


@contextmanager
def collecting() -> Iterator[list[Scratch]]:
    """The scratch folders that are made inside, for whoever knows when their results have been read."""
    made: list[Scratch] = []
    _collecting.append(made)
    try:
        yield made
    finally:
        _collecting.remove(made)


class Scratch:
    """Parquet tables of one run in the shared folder: they cut lineage and survive lost executors.

    What the run does not drop itself goes with ``clear``, or when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0
        fs, path = self._at(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        for made in _collecting[-1:]:
            made.append(self)

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def table(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made:03d}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later result reads."""
        for t in tables:
            fs, path = self._at(t._scratch_path)
            fs.delete(path, True)

    def clear(self, *but: DataFrame) -> None:
        """Deletes all tables but those that a result still reads."""
        keep = {t._scratch_path.rsplit("/", 1)[1] for t in but}
        fs, root = self._at(self.root)
        for s in fs.listStatus(root):
            if s.getPath().getName() not in keep:
                fs.delete(s.getPath(), True)


#: A key is hot if it holds one in so many rows; there are never more hot keys than that.
HOT = 1000


def join_by_key(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "inner", of: Column | None = None) -> DataFrame:
    """left joined with right, which has one row for each key and, in ``weight``, how many rows left has of it at least.

    Rows of hot keys stay where they are: of right at most HOT rows are hot, so those are broadcast. Only the others are
    dealt out by their key, and none of their keys is large. how: inner or left. of: the rows of right that may be joined
    (with inner only); right has to list the keys of the others all the same, so that hot ones among them are known.
    """
    hot = F.col(weight) * HOT >= max(1, total)
    many, few = right.where(hot), right.where(~hot)
    rest = left.join(F.broadcast(many.select(key)), key, "left_anti")
    if of is not None:
        many, few = many.where(of), few.where(of)
    return left.join(F.broadcast(many), key).unionByName(rest.join(few, key, how))


def free(name: str, taken) -> str:
    """The name, with underscores after it while it is taken."""
    while name in taken:
        name += "_"
    return name


def key_hash(col: Column | str) -> Column:
    """Evenly spread 31-bit hash of a key, for samples that do not depend on the order of rows."""
    return F.pmod(F.xxhash64(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")), F.lit(1 << 31))


def fold(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def thinned(df: DataFrame, key: str, strata: str, most: int, counts: dict | None = None) -> DataFrame:
    """About ``most`` rows of each value of ``strata`` at most, chosen by the hash of the key on the executors. counts: the
    rows of each value, if they are known."""
    keep = F.lit(False)
    for value, n in (counts or {r[0]: r[1] for r in df.groupBy(strata).count().collect()}).items():
        rate = min(1.0, most / max(1, n))
        keep = keep | ((F.col(strata) == F.lit(value)) & (key_hash(key) < F.lit(int(rate * (1 << 31)))))
    return df.where(keep)


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """(k, t, y): about ``most`` texts of each label 0 and 1 at most.

    Of labels that repeat the larger counts. The labels are thinned first; what is left has a bound, so it is broadcast and no text is shuffled.
    """
    y = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).groupBy("k").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.join(F.broadcast(thinned(y, "k", "y", most)), "k")


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> list:
    """``labelled_rows`` in the driver's memory, in the order of their ids and texts."""
    # part by part, so that the driver's JVM never holds them all
    return sorted(labelled_rows(docs, labels, id_col, text_col, label_col, most).repartition(8).toLocalIterator(), key=lambda r: (str(r.k), r.t))


class Spool:
    """Texts with labels in a file of the driver's own, in the order of their keys; read one at a time, so that memory does
    not follow their length. The file goes with the object."""

    def __init__(self, rows: Iterable[tuple[str, bytes, int]]):
        self.file = tempfile.TemporaryFile()
        places, end = [], 0
        for key, text, label in rows:
            self.file.write(text)
            places.append((key, hashlib.blake2b(text, digest_size=16).digest(), end, len(text), label))
            end += len(text)
        self.file.flush()
        places.sort()
        self.places, self.labels = [p[2:4] for p in places], [p[4] for p in places]

    def __len__(self) -> int:
        return len(self.places)

    def __getitem__(self, i):
        if isinstance(i, slice):
            return [self[k] for k in range(*i.indices(len(self)))]
        at, n = self.places[i]
        return os.pread(self.file.fileno(), n, at)


def labelled_spool(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> Spool:
    """``labelled_rows`` as a Spool. Long texts make more parts, each of which the driver's JVM holds by itself."""
    rows = labelled_rows(docs, labels, id_col, text_col, label_col, most).hint("rebalance")
    return Spool((str(r.k), r.t.encode(), int(r.y)) for r in rows.toLocalIterator())
