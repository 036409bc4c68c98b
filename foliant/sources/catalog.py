"""The tables under a base folder."""

from __future__ import annotations

import logging
import re

from pyspark.sql import DataFrame, SparkSession

from .files import Files
from .options import parse_options
from .table import ColumnSpec, Table

log = logging.getLogger("foliant")


PUBLIC = "public"


class Catalog:
    """Tables of the schema ``public`` stand in folders of the base; a further schema is a folder with a marker, and its
    tables are in it. Their name here is ``schema__table``, which is what ``schema.table`` is in statements."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base, self.files = spark, base.rstrip("/"), Files(spark)
        self.tables: dict[str, Table] = {}
        self.schemas = {PUBLIC}
        for name in self.files.list(self.base):
            if self.files.exists(f"{self.base}/{name}/_namespace.json"):
                self.schemas.add(name)
                for inner in self.files.list(f"{self.base}/{name}"):
                    self._load(f"{name}/{inner}", f"{name}__{inner}")
            else:
                self._load(name, name)

    def _load(self, folder: str, name: str) -> None:
        if self.files.exists(f"{self.base}/{folder}/_schema.json"):
            try:
                self.tables[name] = Table.load(self.spark, f"{self.base}/{folder}", name)
            except Exception:
                log.warning("table %s cannot be read and is left out", name, exc_info=True)

    def split(self, name: str) -> tuple[str, str]:
        """(schema, table) of a name."""
        schema, _, table = name.partition("__")
        return (schema, table) if table and schema in self.schemas else (PUBLIC, name)

    def create_schema(self, name: str, if_not_exists: bool = False) -> None:
        if not re.fullmatch(r"[^\W\d]\w*", name) or name.startswith("_") or "__" in name or name in self.tables:
            raise ValueError(f"{name!r} cannot be a schema's name")
        if name in self.schemas or not self.files.write_new(f"{self.base}/{name}/_namespace.json", "{}"):
            if not if_not_exists:
                raise ValueError(f"schema {name!r} exists already")
        self.schemas.add(name)

    def drop_schema(self, name: str, if_exists: bool = False, cascade: bool = False) -> None:
        if name not in self.schemas:
            if if_exists:
                return
            raise ValueError(f"there is no schema {name!r}")
        inside = [t for t in self.tables if self.split(t)[0] == name]
        if name == PUBLIC or (inside and not cascade):
            raise ValueError(f"schema {name!r} is in use")
        for t in inside:
            self.drop(t)
        self.files.delete(f"{self.base}/{name}")
        self.schemas.discard(name)

    def create(self, name: str, columns: list[ColumnSpec], options: dict[str, str] | None = None, if_not_exists: bool = False) -> Table:
        if not re.fullmatch(r"[^\W\d]\w*", name) or name.startswith("_"):
            raise ValueError(f"{name!r} cannot be a table's name")
        if name in self.tables:
            if if_not_exists:
                return self.tables[name]
            raise ValueError(f"table {name!r} exists already")
        if name in self.schemas:
            raise ValueError(f"{name!r} is a schema")
        if len({c.name for c in columns}) < len(columns):
            raise ValueError("a column's name repeats")
        schema, own = self.split(name)
        t = Table(self.spark, f"{self.base}/{own}" if schema == PUBLIC else f"{self.base}/{schema}/{own}", name, columns)
        t.save(parse_options(options or {}))
        self.tables[name] = t
        return t

    def drop(self, name: str, if_exists: bool = False) -> None:
        t = self.tables.pop(name, None)
        if t is None:
            if if_exists:
                return
            raise ValueError(f"there is no table {name!r}")
        self.files.delete(t.root)

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise ValueError(f"there is no table {name!r}")
        return self.tables[name]

    def exists(self, name: str) -> bool:
        return name in self.tables

    def names(self) -> list[str]:
        return sorted(self.tables)

    def tables_frame(self) -> DataFrame:
        """(table_schema, table_name, table_type), as an information schema has them."""
        return self.spark.createDataFrame([(*self.split(n), "BASE TABLE") for n in self.names()], "table_schema string, table_name string, table_type string")

    def columns_frame(self) -> DataFrame:
        rows = [(*self.split(n), c.name, i, "YES" if c.nullable else "NO", c.kind) for n in self.names() for i, c in enumerate(self.tables[n].columns, 1)]
        return self.spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string")
