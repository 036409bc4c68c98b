"""The engine: SQL statements and Python calls over a catalog of tables with JSON columns."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, VariantType

from .functions.expressions import render, shown_variant
from .plans.ddl import copy_column, parse_copy, parse_create, parse_insert
from .plans.rewrite import rewrite
from .plans.tokens import tokens
from .sources.catalog import PUBLIC, Catalog
from .sources.table import ColumnSpec, Table
from .schema import quoted, type_of

#: Settings that JSON keys need: keys differ by case, and the last of repeated keys counts.
SETTINGS = {"spark.sql.caseSensitive": "true", "spark.sql.variant.allowDuplicateKeys": "true"}


class Engine:
    """Works in a session of its own, so that the caller's settings and views stay as they are.

    json_types: the spellings of the JSON column type in CREATE TABLE. cache: keep each table's scan in memory until the
    table changes, as far as ``cache_bytes`` (by Spark's estimate) go.
    """

    def __init__(self, spark: SparkSession, base: str, json_types: tuple[str, ...] = ("JSON",), cache: bool = False, cache_bytes: int = 256 << 20):
        self.spark = spark.newSession()
        for k, v in SETTINGS.items():
            self.spark.conf.set(k, v)
        self.catalog = Catalog(self.spark, base)
        self.json_types, self.cache = tuple(t.upper() for t in json_types), cache
        self.cache_bytes, self._cached = cache_bytes, {}  # size of each scan that is kept, oldest first
        self._views: dict[str, tuple[tuple, DataFrame, dict]] = {}
        self._seen: dict[str, dict[str, str]] = {}  # views and the types of their columns

    # -- tables -------------------------------------------------------------------------------------------------------
    def table(self, name: str) -> Table:
        return self.catalog.table(name)

    def tables(self) -> DataFrame:
        return self.catalog.tables_frame()

    def columns(self) -> DataFrame:
        return self.catalog.columns_frame()

    def create_table(self, name: str, columns: list[ColumnSpec], options: dict[str, str] | None = None) -> Table:
        return self.catalog.create(name, columns, options)

    def view(self, name: str, df: DataFrame) -> None:
        """Lets statements read a DataFrame of ``self.spark`` that is no table of the catalog."""
        if name in self.catalog.tables:
            raise ValueError(f"{name!r} is a table")
        df.createOrReplaceTempView(name)
        self._seen[name] = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    # -- statements ---------------------------------------------------------------------------------------------------
    def sql(self, statement: str) -> DataFrame:
        """Runs one statement. Commands give one row: (command, count)."""
        statement = self._qualified(statement)
        words = [t.upper for t in tokens(statement)[:3]]
        if words[:2] in (["CREATE", "SCHEMA"], ["DROP", "SCHEMA"]):
            ts = tokens(statement.strip().rstrip(";"))[2:]
            exists = "EXISTS" in [t.upper for t in ts[:3]]
            cascade = ts[-1].upper == "CASCADE"
            name = ts[-1 - cascade].name
            if words[0] == "CREATE":
                self.catalog.create_schema(name, exists)
            else:
                for t in [t for t in self.catalog.tables if self.catalog.split(t)[0] == name]:
                    self._forget(t)
                self.catalog.drop_schema(name, exists, cascade)
            return self._done(" ".join(words[:2]), 0)
        if words[:2] == ["CREATE", "TABLE"]:
            return self._create(statement)
        if words[:2] == ["DROP", "TABLE"]:
            ts = [t for t in tokens(statement.strip().rstrip(";"))[2:]]
            exists = [t.upper for t in ts[:2]] == ["IF", "EXISTS"]
            name = ts[-1].name
            self._forget(name)
            self.catalog.drop(name, exists)
            return self._done("DROP TABLE", 0)
        if words[:1] == ["INSERT"]:
            return self._done("INSERT", self._insert(statement))
        if words[:1] == ["COPY"]:
            c = parse_copy(statement)
            t = self.catalog.table(c.table)
            n = t.copy_from(c.path, copy_column(t, c.columns), c.format)
            return self._done("COPY", n)
        if words[:2] == ["SHOW", "TABLES"]:
            return self.tables()
        return self._query(statement)

    def _done(self, command: str, n: int) -> DataFrame:
        return self.spark.createDataFrame([(command, n)], "command string, count bigint")

    def _create(self, statement: str) -> DataFrame:
        c = parse_create(statement, self.json_types)
        if c.query is None:
            self.catalog.create(c.name, c.columns, c.options, c.if_not_exists)
            return self._done("CREATE TABLE", 0)
        if c.if_not_exists and self.catalog.exists(c.name):
            return self._done("CREATE TABLE", 0)
        rows, documents = self._queried(c.query)
        t = self.catalog.create(c.name, [ColumnSpec(f.name, "json" if f.name in documents else f.dataType.simpleString()) for f in rows.schema.fields], c.options)
        return self._done("CREATE TABLE", t.insert(rows))

    def _insert(self, statement: str) -> int:
        name, columns, source = parse_insert(statement)
        t = self.catalog.table(name)
        rows = self._query(source)
        names = columns or [c.name for c in t.columns][: len(rows.columns)]
        if len(names) != len(rows.columns):
            raise ValueError(f"INSERT has {len(rows.columns)} values for {len(names)} columns")
        return t.insert(rows.toDF(*names))

    def _forget(self, name: str) -> None:
        found = self._views.pop(name, None)
        if found is not None and self._cached.pop(name, None) is not None:
            found[1].unpersist()

    def _held(self, name: str, df: DataFrame) -> DataFrame:
        """The scan, in memory if the cache is on and has room for it; those that were made first give way."""
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) if self.cache else 0
        if not self.cache or size > self.cache_bytes:
            return df
        while self._cached and sum(self._cached.values()) + size > self.cache_bytes:
            first = next(iter(self._cached))
            del self._cached[first]
            self._views.pop(first)[1].unpersist()
        self._cached[name] = size
        return df.cache()

    def _views_of(self, statement: str) -> dict:
        """Views of the tables that the statement names, as they are now; the types of their JSON columns."""
        named = {t.name for t in tokens(statement) if t.kind in ("word", "quoted")} & set(self.catalog.tables)
        out = {}
        for name in named:
            t = self.catalog.tables[name]
            version = tuple(t.manifest.names())
            if name not in self._views or self._views[name][0] != version:
                self._forget(name)
                df = self._held(name, t.scan())
                df.createOrReplaceTempView(name)
                self._views[name] = (version, df, t.types())
            out[name] = self._views[name][2]
        return out

    def _query(self, statement: str) -> DataFrame:
        return self._queried(statement)[0]

    def _queried(self, statement: str) -> tuple[DataFrame, set[str]]:
        """The rows, and which columns are whole JSON columns."""
        statement = self._information(statement)
        schemas = self._views_of(statement)
        names = {c.name for t in schemas for c in self.catalog.tables[t].columns} | set(self.catalog.tables)
        plain = dict(self._seen) | {t: {c.name: c.kind for c in self.catalog.tables[t].columns if not c.is_json} for t in schemas}
        text, derived, documents = rewrite(statement.strip().rstrip(";"), schemas, names.union(self._seen, *self._seen.values()), plain, self._analysed)
        df = self._rendered(self.spark.sql(text), {c: t for c, (t, is_text) in derived.items() if not is_text} | {c: t for s in schemas.values() for c, t in s.items()})
        return df, documents

    def _qualified(self, statement: str) -> str:
        """``schema.table`` as the table's one name, where it names a table there is or one that is made or dropped."""
        ts, out, at = tokens(statement), [], 0
        for i, t in enumerate(ts[:-2]):
            if ts[i + 1].text != "." or t.kind not in ("word", "quoted") or t.name not in self.catalog.schemas or (i and ts[i - 1].text == "."):
                continue
            own = ts[i + 2].name
            name = own if t.name == PUBLIC else f"{t.name}__{own}"
            command = ts[0].upper in ("CREATE", "DROP", "INSERT", "COPY") and i and ts[i - 1].upper in ("TABLE", "EXISTS", "INTO", "COPY")
            if t.at >= at and (name in self.catalog.tables or command):
                out.append(statement[at : t.at] + name)
                at = ts[i + 2].end
        return "".join(out) + statement[at:]

    def _information(self, statement: str) -> str:
        """``information_schema.tables`` and ``.columns`` as views of what the catalog holds now."""
        ts, out, at = tokens(statement), [], 0
        for i, t in enumerate(ts[:-2]):
            if t.name == "information_schema" and ts[i + 1].text == "." and ts[i + 2].name in ("tables", "columns"):
                view = f"information_schema_{ts[i + 2].name}"
                (self.tables() if ts[i + 2].name == "tables" else self.columns()).createOrReplaceTempView(view)
                out.append(statement[at : t.at] + view)
                at = ts[i + 2].end
        return "".join(out) + statement[at:]

    def _analysed(self, query: str):
        """The type of column x of a query, or None if Spark cannot tell it from the query alone."""
        try:
            return type_of(self.spark.sql(query).schema["x"].dataType)
        except AnalysisException:
            return None

    def _rendered(self, df: DataFrame, types: dict) -> DataFrame:
        """JSON columns that come out whole, as by ``SELECT *``, are shown as text."""
        if not any(f.name in types and isinstance(f.dataType, (StructType, VariantType)) for f in df.schema.fields):
            return df
        out = []
        for f in df.schema.fields:
            if f.name in types and isinstance(f.dataType, StructType):
                out.append(F.expr(render(quoted(f.name), types[f.name])).alias(f.name))
            elif f.name in types and isinstance(f.dataType, VariantType):
                out.append(F.expr(shown_variant(quoted(f.name))).alias(f.name))
            else:
                out.append(F.col(quoted(f.name)))
        return df.select(*out)
