"""A registered data source for folders of array files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "array_files"
# Bytes of files in a partition, and a file's share of it beyond its own, as with Spark's own sources.
PARTITION_BYTES = 64 << 20
OPEN_BYTES = 1 << 20
_ROWS = 64
# What each column needs: nothing but the listing, the file's header, or its values.
LISTED = ("stem", "path", "length")
HEADER = ("shape", "dtype")
COLUMNS = {
    "stem": (T.StringType(), pa.string()), "path": (T.StringType(), pa.string()), "length": (T.LongType(), pa.int64()),
    "shape": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), "dtype": (T.StringType(), pa.string()),
    "values": (T.ArrayType(T.DoubleType()), pa.list_(pa.float64())), "reason": (T.StringType(), pa.string()),
}


@dataclass
class Files(InputPartition):
    """Files that one task reads: (path, length)."""

    files: list[tuple[str, int]]


class ArraySource(DataSource):
    """Array files of a folder: (stem, path, length, shape, dtype, values, reason), values flattened row-major.

    ``spark.read.format("array_files").load(folder)``, after :func:`register`. With ``.schema(...)`` only the named columns are made: for
    those of the listing no file is opened, for shape and type only a file's first bytes are read. A file that is no plain numeric
    array has a reason and no values; nothing is unpickled. The folder may lie in any store that Arrow's file systems
    reach. Options: ``ext`` (".npy"), ``partition_bytes``.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, t) for n, (t, _) in COLUMNS.items()])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        unknown = [f.name for f in schema.fields if f.name not in COLUMNS or f.dataType != COLUMNS[f.name][0]]
        if unknown:
            raise ValueError(f"no such columns: {', '.join(unknown)}")
        return ArrayReader([f.name for f in schema.fields], dict(self.options))


class ArrayReader(DataSourceReader):
    def __init__(self, columns: list[str], options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("the folder is missing: load(folder)")
        self.columns, self.path = columns, options["path"]
        self.ext = options.get("ext", ".npy")
        self.most = int(options.get("partition_bytes", PARTITION_BYTES))

    def partitions(self) -> list[Files]:
        """Files by falling length, each into the emptiest partition of about equal bytes."""
        store, folder = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        found = store.get_file_info(fs.FileSelector(folder))
        files = [(f.path, f.size) for f in found if f.is_file and f.path.endswith(self.ext) and f.base_name[0] not in "_."]
        # Without values only the listing or the headers count.
        cost = [(OPEN_BYTES + (size if "values" in self.columns else 0), (path, size)) for path, size in sorted(files)]
        count = max(1, -(-sum(c for c, _ in cost) // self.most))
        parts: list[list[tuple[str, int]]] = [[] for _ in range(count)]
        for i, (_, file) in enumerate(sorted(cost, reverse=True)):
            turn, place = divmod(i, count)
            parts[place if turn % 2 == 0 else count - 1 - place].append(file)
        return [Files(p) for p in parts]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        for start in range(0, len(partition.files), _ROWS):
            rows = [self._row(store, path, size) for path, size in partition.files[start:start + _ROWS]]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], COLUMNS[c][1]) for c in self.columns], names=self.columns)

    def _row(self, store: fs.FileSystem, path: str, size: int) -> dict:
        name = path.rsplit("/", 1)[-1]
        row = {"stem": re.sub(r"^(\.*[^.].*)\.[^.]*$", r"\1", name), "path": path, "length": size, **dict.fromkeys(("shape", "dtype", "values", "reason"))}
        if set(self.columns) <= set(LISTED):
            return row
        try:
            with store.open_input_stream(path, buffer_size=4096) as stream:
                version = np.lib.format.read_magic(stream)
                read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
                shape, by_column, kind = read(stream)
                if kind.kind not in "fiu":
                    row["reason"] = "not a numeric array"
                    return row
                row["shape"], row["dtype"] = list(shape), kind.name
                if "values" in self.columns or "reason" in self.columns:
                    flat = np.frombuffer(stream.read(), kind)
                    row["values"] = flat.reshape(shape, order="F" if by_column else "C").reshape(-1).astype(np.float64)
        except Exception as problem:
            row.update(shape=None, dtype=None, values=None, reason=f"unreadable: {type(problem).__name__}")
        return row


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(ArraySource)
