"""A cursor-paged service as a Spark data source. The pager is any importable callable, so nothing here opens a
connection: cursor -> (rows, next cursor or None)."""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedReader(DataSourceReader):
    """One partition per starting cursor, each followed until it ends or most rows have been given. keep: a predicate of a
    row, "module:function"; rows that fail it are neither given nor counted."""

    def __init__(self, options: dict) -> None:
        module, _, name = options["pager"].partition(":")
        self.module, self.name = module, name
        self.cursors = options.get("cursors", "*").split(",")
        self.most = int(options.get("most", 0))
        self.keep = options.get("keep")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(c) for c in self.cursors]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        pager, cursor, given = getattr(importlib.import_module(self.module), self.name), partition.value, 0
        kept = getattr(importlib.import_module(self.keep.split(":")[0]), self.keep.split(":")[1]) if self.keep else None
        while cursor is not None:
            rows, cursor = pager(cursor)
            for r in rows:
                if kept and not kept(r):
                    continue
                if self.most and given >= self.most:
                    return
                given += 1
                yield tuple(r)


class PagedSource(DataSource):
    """spark.read.format("paged").schema(...).option("pager", "module:function").load()"""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: object) -> PagedReader:
        return PagedReader(dict(self.options))
