"""The change log as a Spark data source, for batches and for streams: the offset is a change id.

``spark.read.format("change_log").load(root)`` reads it, and a lower bound on change_id that
Spark pushes down leaves older commits' files closed.  ``spark.readStream`` plans what lies
between two ids into ranges, one for each commit's part of at most ``RANGE`` changes, so
that a stream that starts again from its checkpoint reads each change once.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

SCHEMA = "change_id bigint, doc_id string, op string"
#: Changes of one partition, at most.
RANGE = 1_000_000


@dataclass
class Part(InputPartition):
    """The changes from ``low`` to ``high`` of one commit's folder, whose first change has the id ``first``."""

    folder: str
    first: int
    low: int
    high: int


class Log:
    """The commits below a root, on any file system that Arrow knows."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.root = root.rstrip("/")
        self.files, self.path = fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root.removeprefix("file:"))

    def _commit(self, number: int) -> dict:
        with self.files.open_input_stream(f"{self.path}/commits/{number:020d}.json") as f:
            return json.loads(f.read())

    def newest(self) -> int:
        """The number of the newest commit; 0 if there is none."""
        from pyarrow import fs

        names = [i.base_name for i in self.files.get_file_info(fs.FileSelector(f"{self.path}/commits", allow_not_found=True))]
        return max((int(n[:20]) for n in names if n.endswith(".json")), default=0)

    def last_id(self) -> int:
        n = self.newest()
        return self._commit(n)["next_id"] - 1 if n else 0

    def parts(self, after: int, upto: int | None = None) -> list[Part]:
        """Ranges of the ids after one and up to another: commits are read from the newest back to where they begin."""
        out, n = [], self.newest()
        while n:
            commit = self._commit(n)
            own = commit["changes"]
            if own:
                low, high = max(own["first"], after + 1), own["first"] + own["n"] - 1
                high = high if upto is None else min(high, upto)
                out += [Part(own["folder"], own["first"], at, min(high, at + RANGE - 1)) for at in range(low, high + 1, RANGE)]
            if commit["next_id"] - 1 <= after or own and own["first"] <= after + 1:
                break
            n -= 1
        return sorted(out, key=lambda p: p.low)


def read_part(part: Part) -> Iterator:
    """The changes of a range as Arrow batches."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.dataset as ds

    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(part.folder) if "://" in part.folder else (fs.LocalFileSystem(), part.folder.removeprefix("file:"))
    within = (ds.field("ordinal") >= part.low - part.first) & (ds.field("ordinal") <= part.high - part.first)
    for b in ds.dataset(path, format="parquet", filesystem=files).to_batches(columns=["ordinal", "doc_id", "op"], filter=within):
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pc.add(b.column("ordinal"), part.first), b.column("doc_id"), b.column("op")], names=["change_id", "doc_id", "op"])


class Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root, self.after = root, 0

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Lower bounds on change_id choose files; Spark looks at every row again."""
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("change_id",):
                self.after = max(self.after, f.value - (0 if isinstance(f, GreaterThan) else 1))
            yield f

    def partitions(self) -> list[Part]:
        return Log(self.root).parts(self.after)

    def read(self, partition: Part) -> Iterator:
        yield from read_part(partition) if isinstance(partition, Part) else ()


class StreamReader(DataSourceStreamReader):
    def __init__(self, root: str, after: int):
        self.root, self.after = root, after

    def initialOffset(self) -> dict:
        return {"change_id": self.after}

    def latestOffset(self) -> dict:
        return {"change_id": Log(self.root).last_id()}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return Log(self.root).parts(start["change_id"], end["change_id"])

    def read(self, partition: Part) -> Iterator:
        yield from read_part(partition)

    def commit(self, end: dict) -> None:
        pass


class ChangeLog(DataSource):
    """``path`` is the store's root; ``after`` is the id that a stream starts behind."""

    @classmethod
    def name(cls) -> str:
        return "change_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options["path"], int(self.options.get("after", 0)))


def register(spark) -> None:
    """Makes the format known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChangeLog)
