"""Data source adapters: a user's source as a Spark data source with partitions and pushed filters."""

from __future__ import annotations

import sqlite3
from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator
from importlib import import_module
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

#: Comparisons that an adapter may be asked to make itself, by the filter that Spark pushes.
COMPARISONS: dict[type, str] = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in", IsNull: "is null", IsNotNull: "is not null"}
#: ``column, comparison, value``: a tuple for ``in``, None for the null tests.
Condition = tuple[str, str, Any]


class Adapter(ABC):
    """What a source has to say.  It is made from the reader's options on the driver and sent to the tasks, so it must be picklable."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    @abstractmethod
    def schema(self) -> str:
        """The columns as DDL."""

    @abstractmethod
    def partitions(self, conditions: list[Condition]) -> list[Any]:
        """Parts that tasks read on their own; parts without rows under the conditions may be left out."""

    @abstractmethod
    def read(self, partition: Any, conditions: list[Condition]) -> Iterable[pa.RecordBatch]:
        """A part's rows that meet the conditions, a batch at a time."""

    def takes(self, condition: Condition) -> bool:
        """Whether the source applies the condition itself; those that it doesn't are applied by Spark."""
        return False


class _Part(InputPartition):
    def __init__(self, value: Any):
        super().__init__(value)


class _Reader(DataSourceReader):
    def __init__(self, adapter: Adapter):
        self.adapter, self.conditions = adapter, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            found = condition_of(f)
            if found and self.adapter.takes(found):
                self.conditions.append(found)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in self.adapter.partitions(self.conditions)] or [_Part(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is not None:
            yield from self.adapter.read(partition.value, self.conditions)


def condition_of(f: Filter) -> Condition | None:
    """A pushed filter on one column as a condition; None for any other."""
    kind = EqualTo if isinstance(f, EqualNullSafe) and f.value is not None else type(f)
    if kind not in COMPARISONS or len(f.attribute) != 1:
        return None
    return f.attribute[0], COMPARISONS[kind], getattr(f, "value", None)


class AdapterSource(DataSource):
    """Format ``docquarry``: ``option("adapter", "package.module:Class")`` and the adapter's own options."""

    @classmethod
    def name(cls) -> str:
        return "docquarry"

    def _adapter(self) -> Adapter:
        module, _, name = self.options["adapter"].partition(":")
        return getattr(import_module(module), name)(dict(self.options))

    def schema(self) -> str:
        return self._adapter().schema()

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._adapter())


def read_source(spark: SparkSession, adapter: type[Adapter], **options: str) -> DataFrame:
    """The adapter's rows as a DataFrame, whose filters reach the adapter as far as it takes them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AdapterSource)
    return spark.read.format("docquarry").options(adapter=f"{adapter.__module__}:{adapter.__qualname__}", **options).load()


class SqliteAdapter(Adapter):
    """A table of an SQLite file on a shared file system: options ``path, table, key`` (a whole number) and ``parts``.

    Parts are ranges of the key; comparisons with numbers and texts are part of the SQL, with their values as parameters.  A row without a
    key is in the first part.
    """

    _TYPES = {"INTEGER": "bigint", "INT": "bigint", "BIGINT": "bigint", "REAL": "double", "TEXT": "string", "BLOB": "binary"}
    _ROWS = 2000

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def _columns(self) -> list[tuple[str, str]]:
        with self._open() as db:
            return [(r[1], self._TYPES.get(r[2].upper(), "string")) for r in db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})")]

    def schema(self) -> str:
        return ", ".join(f"`{n}` {t}" for n, t in self._columns())

    def takes(self, condition: Condition) -> bool:
        _, comparison, value = condition
        values = value if comparison == "in" else (value,)
        return comparison.startswith("is") or all(isinstance(v, int | float | str) and not isinstance(v, bool) for v in values)

    def where(self, conditions: list[Condition]) -> tuple[str, list[Any]]:
        """The conditions as SQL and its parameters."""
        parts, values = ["1 = 1"], []
        for column, comparison, value in conditions:
            if comparison.startswith("is"):
                parts.append(f"{_quoted(column)} {comparison}")
            else:
                own = list(value) if comparison == "in" else [value]
                parts.append(f"{_quoted(column)} {comparison} " + (f"({', '.join('?' * len(own))})" if comparison == "in" else "?"))
                values += own
        return " AND ".join(parts), values

    def partitions(self, conditions: list[Condition]) -> list[Any]:
        where, values = self.where(conditions)
        with self._open() as db:
            count, low, high = db.execute(f"SELECT count(*), min({self._key}), max({self._key}) FROM {_quoted(self.options['table'])} WHERE {where}", values).fetchone()
        if not count:
            return []
        if low is None:
            return [(None, None)]
        parts = min(int(self.options.get("parts", "8")), high - low + 1)
        cuts = [low + (high - low + 1) * i // parts for i in range(1, parts)]
        return list(zip([None, *cuts], [*cuts, None], strict=True))

    @property
    def _key(self) -> str:
        return _quoted(self.options["key"])

    def read(self, partition: Any, conditions: list[Condition]) -> Iterable[pa.RecordBatch]:
        where, values = self.where(conditions)
        low, high = partition
        if low is not None:
            where, values = f"{where} AND {self._key} >= ?", [*values, low]
        if high is not None:
            where, values = f"{where} AND ({self._key} < ?" + (f" OR {self._key} IS NULL)" if low is None else ")"), [*values, high]
        kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
        columns = self._columns()
        with self._open() as db:
            found = db.execute(f"SELECT {', '.join(_quoted(n) for n, _ in columns)} FROM {_quoted(self.options['table'])} WHERE {where}", values)
            while rows := found.fetchmany(self._ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows, strict=True), columns, strict=True)], [n for n, _ in columns])


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'
