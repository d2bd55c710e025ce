"""A table read in key ranges: a Python data source for batches and streams.

The table is a folder of Parquet files with an integer key that grows with time.  A batch read covers a
range of keys in even parts; a stream's offset is the last key it has read, so a restart with its
checkpoint goes on behind that key.  Each part is a predicate on the key that reaches the files' row
groups.  Rows with a key at or below the offset that arrive later are not seen, as with every keyset.

    spark.dataSource.register(KeysetSource)
    spark.read.format("keyset").option("path", p).option("key", "id").schema("id long, ...").load()
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader,
                                    InputPartition)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PARTITIONS = 8


class KeyRange(InputPartition):
    """Keys above ``after`` up to and including ``upto``."""

    def __init__(self, after: int, upto: int):
        self.after, self.upto = after, upto


def even_ranges(after: int, upto: int, parts: int) -> list[KeyRange]:
    """At most ``parts`` ranges that cover (after, upto] without overlap, none of them empty."""
    width = upto - after
    if width <= 0:
        return []
    cuts = [after + width * k // parts for k in range(parts + 1)]
    return [KeyRange(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


class Keyset:
    """Options shared by both readers, and the reading of one range."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.path, self.key = options["path"], options["key"]
        self.after = int(options.get("after", -(1 << 63)))
        self.upto = int(options["upto"]) if "upto" in options else None
        self.parts = int(options.get("partitions", PARTITIONS))
        self.schema = to_arrow_schema(schema)
        self.names = schema.fieldNames()

    def table(self) -> ds.Dataset:
        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith(
            "file:") else (fs.LocalFileSystem(), self.path)
        return ds.dataset(path, filesystem=system, format="parquet", partitioning="hive",
                          exclude_invalid_files=False)

    def bounds(self) -> tuple[int, int] | None:
        """Smallest and largest key, from the statistics in the files' footers."""
        least = most = None
        for fragment in self.table().get_fragments():
            for group in fragment.row_groups:
                found = group.statistics.get(self.key) if group.statistics else None
                if found is None:  # written without statistics, or nulls only
                    column = group_keys(fragment, group.id, self.key)
                    if column.null_count == len(column):
                        continue
                    found = pc.min_max(column).as_py()
                least = found["min"] if least is None else min(least, found["min"])
                most = found["max"] if most is None else max(most, found["max"])
        return None if least is None else (least, most)

    def rows(self, part: KeyRange) -> Iterator[pa.RecordBatch]:
        wanted = (ds.field(self.key) > part.after) & (ds.field(self.key) <= part.upto)
        scan = self.table().scanner(columns=self.names, filter=wanted, batch_size=1 << 14,
                                    use_threads=False)
        for batch in scan.to_batches():
            if batch.num_rows:
                yield batch.cast(self.schema)


def group_keys(fragment, group: int, key: str) -> pa.ChunkedArray:
    return fragment.subset(row_group_ids=[group]).to_table(columns=[key]).column(0)


class KeysetReader(Keyset, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        found = self.bounds()
        if found is None:
            return []
        after = max(self.after, found[0] - 1)
        upto = found[1] if self.upto is None else min(self.upto, found[1])
        return even_ranges(after, upto, self.parts)

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        yield from self.rows(partition)


class KeysetStream(Keyset, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"key": self.after}

    def latestOffset(self) -> dict:
        found = self.bounds()
        last = self.after if found is None else max(self.after, found[1])
        return {"key": last if self.upto is None else min(last, self.upto)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        found = self.bounds()
        if found is None:
            return []
        # a first offset lies far below the first key
        return even_ranges(max(start["key"], found[0] - 1), end["key"], self.parts)

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        yield from self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class KeysetSource(DataSource):
    """Options: path, key; after and upto (bounds of the keys), partitions.  The schema is required."""

    @classmethod
    def name(cls) -> str:
        return "keyset"

    def schema(self) -> str:
        raise ValueError("give the schema of the columns to read")

    def reader(self, schema: StructType) -> KeysetReader:
        return KeysetReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> KeysetStream:
        return KeysetStream(schema, dict(self.options))
