"""Python data sources of graph files: GraphML, Matrix Market, Pajek and Arrow IPC.

These formats have state across lines (sections, headers, key tables), so one
file is one partition; a folder or glob of files reads in parallel.
"""

from __future__ import annotations

import glob
import os
import re

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_EDGE = "source long, target long, weight long"


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://").removeprefix("file:")
    if os.path.isdir(path):
        return sorted(p for p in glob.glob(os.path.join(path, "*")) if os.path.isfile(p) and not os.path.basename(p).startswith((".", "_")))
    found = sorted(glob.glob(path))
    if not found:
        raise FileNotFoundError(path)
    return found


def whole(text: str, what: str) -> int:
    """A non-negative decimal integer (also written as 3.0)."""
    text = text.strip()
    if re.fullmatch(r"\d+", text):
        return int(text)
    try:
        value = float(text)
    except ValueError:
        raise ValueError(f"{what} must be a non-negative integer, not {text!r}") from None
    if value < 0 or value != int(value):
        raise ValueError(f"{what} must be a non-negative integer, not {text!r}")
    return int(value)


def graphml(path: str):
    """Edges of a GraphML file: ids are decimal, the weight is the data of the key named weight (default 1)."""
    from xml.etree import ElementTree

    key, name = None, lambda e: e.tag.rpartition("}")[2]
    for event, e in ElementTree.iterparse(path, events=("start", "end")):
        if event == "start" and name(e) == "key" and e.get("attr.name") == "weight":
            key = e.get("id")
        if event == "end" and name(e) == "edge":
            weight = 1
            for data in e:
                if name(data) == "data" and data.get("key") == key and key is not None:
                    weight = whole(data.text or "", "weight")
            yield whole(e.get("source"), "source"), whole(e.get("target"), "target"), weight
            e.clear()


def matrix_market(path: str):
    """Coordinate entries, 1-based; a symmetric header is not expanded."""
    with open(path) as lines:
        sized = False
        for line in lines:
            if not line.strip() or line.startswith("%"):
                continue
            f = line.split()
            if not sized:
                sized = True
                continue
            if len(f) < 3:
                raise ValueError("matrix entries need row, column and value")
            i, j = whole(f[0], "row") - 1, whole(f[1], "column") - 1
            if min(i, j) < 0:
                raise ValueError("matrix entries are 1-based")
            yield i, j, whole(f[2], "value")


def pajek(path: str):
    """Rows after *Arcs or *Edges, 1-based, weight 1 by default; edges are not mirrored."""
    with open(path) as lines:
        inside = False
        for line in lines:
            if line.startswith("*"):
                inside = line.strip().lower().startswith(("*arcs", "*edges"))
            elif inside and line.strip() and not line.startswith("%"):
                f = line.split()
                i, j = whole(f[0], "source") - 1, whole(f[1], "target") - 1
                if min(i, j) < 0:
                    raise ValueError("vertices are 1-based")
                yield i, j, whole(f[2], "weight") if len(f) > 2 else 1


class _Reader(DataSourceReader):
    def __init__(self, path: str, read):
        self.files, self.read_file = _files(path), read

    def partitions(self):
        return [InputPartition(f) for f in self.files]

    def read(self, partition):
        yield from self.read_file(partition.value)


def _source(short: str, read):
    class Source(DataSource):
        @classmethod
        def name(cls):
            return short

        def schema(self):
            return _EDGE

        def reader(self, schema):
            return _Reader(self.options["path"], read)

    return Source


class ArrowFiles(DataSource):
    """Arrow IPC files; the schema is that of the first."""

    @classmethod
    def name(cls):
        return "nullweave_ipc"

    def schema(self):
        import pyarrow as pa
        from pyspark.sql.pandas.types import from_arrow_schema

        with pa.OSFile(_files(self.options["path"])[0]) as f:
            return from_arrow_schema(signed(pa.ipc.open_file(f).schema.empty_table()).schema)

    def reader(self, schema):
        return _Reader(self.options["path"], arrow_batches)


def signed(table):
    """Unsigned 64-bit columns as signed ones (Spark has no unsigned types)."""
    import pyarrow as pa

    kinds = [pa.int64() if pa.types.is_unsigned_integer(f.type) else f.type for f in table.schema]
    return table.cast(pa.schema([f.with_type(k) for f, k in zip(table.schema, kinds)]))


def arrow_batches(path: str):
    import pyarrow as pa

    with pa.OSFile(path) as f:
        yield from signed(pa.ipc.open_file(f).read_all()).to_batches()


def register(spark: SparkSession) -> None:
    for short, read in (("nullweave_graphml", graphml), ("nullweave_mtx", matrix_market), ("nullweave_pajek", pajek)):
        spark.dataSource.register(_source(short, read))
    spark.dataSource.register(ArrowFiles)
