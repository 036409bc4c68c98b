"""A table: declared columns, some of them JSON, over the file sets of its manifest."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import as_text, as_type, conform, natural, render
from ..operators.convert import converted
from ..operators.infer import inspect
from ..operators.value_counts import value_counts
from ..plans.hints import Hint
from ..schema import Type, known, merge, quoted, spark_type, with_path
from .files import Files
from .manifest import FileSet, Manifest
from .options import writer_options


@dataclass
class ColumnSpec:
    """kind: a Spark SQL type, or ``json``."""

    name: str
    kind: str
    nullable: bool = True
    hints: list[Hint] = field(default_factory=list)

    @property
    def is_json(self) -> bool:
        return self.kind == "json"


def costly(df: DataFrame) -> bool:
    """Whether the rows come from more than scans and row-by-row work, so that reading them twice would not be cheap."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return any(f"{name} " in plan or f"{name}\n" in plan for name in ("Join", "Aggregate", "Window", "Sort", "Distinct", "RepartitionByExpression", "MapInArrow", "MapInPandas"))


class Table:
    def __init__(self, spark: SparkSession, root: str, name: str, columns: list[ColumnSpec]):
        self.spark, self.root, self.name, self.columns = spark, root, name, columns
        self.files = Files(spark)
        self.manifest = Manifest(self.files, f"{root}/_manifest")

    # -- declaration ------------------------------------------------------------------------------------------------
    def save(self, options: dict) -> None:
        spec = [{"name": c.name, "kind": c.kind, "nullable": c.nullable, "hints": [h.as_json() for h in c.hints]} for c in self.columns]
        if not self.files.write_new(f"{self.root}/_schema.json", json.dumps(spec, ensure_ascii=False)):
            raise ValueError(f"table {self.name!r} exists already")
        self.manifest.append("options", options=options)

    @classmethod
    def load(cls, spark: SparkSession, root: str, name: str) -> Table:
        spec = json.loads(Files(spark).read(f"{root}/_schema.json"))
        return cls(spark, root, name, [ColumnSpec(c["name"], c["kind"], c["nullable"], [Hint(**h) for h in c["hints"]]) for c in spec])

    def column(self, name: str) -> ColumnSpec:
        found = next((c for c in self.columns if c.name == name), None)
        if found is None:
            raise ValueError(f"table {self.name!r} has no column {name!r}")
        return found

    def json_columns(self) -> list[str]:
        return [c.name for c in self.columns if c.is_json]

    # -- reading ----------------------------------------------------------------------------------------------------
    def types(self) -> dict[str, Type | None]:
        """The merged type of each JSON column over all file sets; hinted paths are always there."""
        sets, _ = self.manifest.state()
        out: dict[str, Type | None] = {}
        for c in self.columns:
            if c.is_json:
                t = reduce(merge, (s.types.get(c.name) or "null" for s in sets), "null")
                for h in c.hints:
                    t = with_path(t, h.path, h.type)
                out[c.name] = known(t)
        return out

    def scan(self) -> DataFrame:
        """All rows, JSON columns as nested columns of their merged type. File sets of one stored schema are read
        together, conformed by expressions, and united; column pruning and filters reach each reader."""
        sets, _ = self.manifest.state()
        types = self.types()
        groups: dict[str, list[FileSet]] = {}
        for s in sets:
            groups.setdefault(json.dumps([s.types, s.columns], sort_keys=True), []).append(s)
        parts = []
        for group in groups.values():
            schema = ", ".join(f"{quoted(k)} {v}" for k, v in group[0].columns.items())
            df = self.spark.read.schema(schema).parquet(*(f"{self.root}/{s.id}" for s in group))
            parts.append(df.select(*(F.expr(e).alias(n) for n, e in self._conformed(group[0], types))))
        if not parts:
            schema = ", ".join(f"{quoted(c.name)} {self._stored(c, types)}" for c in self.columns)
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, parts)

    def _stored(self, c: ColumnSpec, types: dict) -> str:
        return (spark_type(types[c.name]) if types[c.name] else "struct<value: string>") if c.is_json else c.kind

    def _conformed(self, s: FileSet, types: dict) -> list[tuple[str, str]]:
        out = []
        for c in self.columns:
            if not c.is_json:
                have = s.columns.get(c.name)
                out.append((c.name, f"CAST({quoted(c.name)} AS {c.kind})" if have else f"CAST(NULL AS {c.kind})"))
            elif types[c.name] is None:
                out.append((c.name, f"CAST(NULL AS {self._stored(c, types)})"))
            else:
                out.append((c.name, conform(quoted(c.name), known(s.types.get(c.name) or "null"), types[c.name])))
        return out

    def rendered(self) -> DataFrame:
        """All rows with JSON columns as JSON text."""
        types = self.types()
        return self.scan().select(*(F.expr(render(quoted(c.name), types[c.name])).alias(c.name) if c.is_json else F.col(quoted(c.name)) for c in self.columns))

    def text(self, column: str, path: str = "") -> str:
        """SQL text of the untyped getter over ``scan``."""
        return as_text(quoted(column), self.types()[column], path)

    def typed(self, column: str, path: str, kind: str | None = None) -> str:
        """SQL text of the typed getter over ``scan``; without a type the leaf's own."""
        t = self.types()[column]
        return as_type(quoted(column), t, path, kind) if kind else natural(quoted(column), t, path)[0]

    def value_counts(self, column: str, path: str, ordered: bool = True) -> DataFrame:
        return value_counts(self.scan(), self.text(column, path), ordered=ordered)

    # -- writing ----------------------------------------------------------------------------------------------------
    def insert(self, rows: DataFrame, mode: str = "append") -> int:
        """Appends rows whose JSON columns are texts; missing columns are NULL. One pass tests and infers, one converts
        and writes; the rows are visible once the manifest has them. The number of rows."""
        if mode != "append":
            raise ValueError(f"insert mode {mode!r} is not supported")
        extra = set(rows.columns) - {c.name for c in self.columns}
        if extra:
            raise ValueError(f"table {self.name!r} has no columns {sorted(extra)}")
        given = rows.select(*((F.col(quoted(c.name)).cast("string" if c.is_json else c.kind) if c.name in rows.columns else F.lit(None).cast("string" if c.is_json else c.kind)).alias(c.name) for c in self.columns))
        held = costly(given)
        if held:  # read twice below; blocks of lost executors are made again from the input
            given = given.persist(StorageLevel.DISK_ONLY)
        try:
            documents = {c.name: c.hints for c in self.columns if c.is_json}
            required = [c.name for c in self.columns if not c.nullable and not c.is_json]
            types = inspect(given, documents, required)
            for c in self.columns:
                for h in c.hints:
                    types[c.name] = with_path(types[c.name], h.path, h.type)
            out = given.select(*(converted(c.name, types[c.name]).alias(c.name) if c.is_json else F.col(quoted(c.name)) for c in self.columns))
            return self._write(out, types)
        finally:
            if held:
                given.unpersist()

    def _write(self, out: DataFrame, types: dict[str, Type]) -> int:
        from pyspark.sql import Observation

        _, options = self.manifest.state()
        seen, new = Observation(), uuid.uuid4().hex
        out.observe(seen, F.count(F.lit(1)).alias("n")).write.options(**writer_options(options)).parquet(f"{self.root}/{new}")
        n = int(seen.get["n"])
        if not n:
            self.files.delete(f"{self.root}/{new}")
            return 0
        columns = {f.name: f.dataType.simpleString() if not c.is_json else (spark_type(known(types[c.name])) if known(types[c.name]) else "struct<value: string>") for f, c in zip(out.schema.fields, self.columns, strict=True)}
        self.manifest.add(FileSet(new, types, columns))
        return n

    def compact(self) -> None:
        """Writes all rows as one file set of the merged types, in place of the present ones."""
        sets, options = self.manifest.state()
        if len(sets) > 1:
            types, new = {k: v or "null" for k, v in self.types().items()}, uuid.uuid4().hex
            df = self.scan()
            df.write.options(**writer_options(options)).parquet(f"{self.root}/{new}")
            columns = {c.name: self._stored(c, self.types()) for c in self.columns}
            self.manifest.replace([s.id for s in sets], [FileSet(new, types, columns)])

    def copy_from(self, path: str, column: str | None = None, format: str | None = None) -> int:
        """Appends one document for each line that is not blank; other columns are NULL."""
        from ..plans.ddl import copy_column

        if format and format.lower() not in ("json", "ndjson"):
            raise ValueError(f"{format.lower()!r} cannot be copied; the formats are json and ndjson")
        name = copy_column(self, [column] if column else [])
        lines = self.spark.read.text(path).where("trim(value) <> ''").select(F.col("value").alias(name))
        return self.insert(lines)
