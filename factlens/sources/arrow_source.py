"""Arrow IPC files as a data source: partitions are runs of record batches, found in each file's footer."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "factlens_arrow"
#: Bytes of a file that one task reads, about; a batch is never split.
TASK_BYTES = 64 << 20


def opened(path: str):
    """(file system, path in it) of a path or URI that pyarrow reaches; raises pa.ArrowInvalid for other stores."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = path.removeprefix("file://").removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files: the one, or those of the folder by name, without hidden ones."""
    from pyarrow import fs

    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(at, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    inside = store.get_file_info(fs.FileSelector(at))
    return sorted((f.path, f.size) for f in inside if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


class Run(InputPartition):
    """Batches first to last - 1 of a file."""

    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first, last))
        self.path, self.first, self.last = path, first, last


class ArrowReader(DataSourceReader):
    def __init__(self, path: str, task_bytes: int, names: list[str]):
        self.path, self.task_bytes, self.names = path, task_bytes, names

    def partitions(self):
        store, _ = opened(self.path)
        out = []
        for at, size in files_of(self.path):
            with store.open_input_file(at) as f:  # the footer alone
                n = pa.ipc.open_file(f).num_record_batches
            step = max(1, -(-n * self.task_bytes // max(size, 1)))
            out += [Run(at, i, min(i + step, n)) for i in range(0, n, step)]
        return out or [Run("", 0, 0)]

    def read(self, partition: Run):
        if partition.first >= partition.last:
            return
        store, _ = opened(self.path)
        with store.open_input_file(partition.path) as f:
            reader = pa.ipc.open_file(f)
            if reader.schema.names != self.names:
                raise ValueError(f"{partition.path} has columns {reader.schema.names}, not {self.names}")
            for i in range(partition.first, partition.last):
                yield reader.get_batch(i)


class ArrowSource(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def _first(self) -> pa.Schema:
        files = files_of(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no file in {self.options['path']}")
        with opened(self.options["path"])[0].open_input_file(files[0][0]) as f:
            return pa.ipc.open_file(f).schema

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(self._first())

    def reader(self, schema):
        return ArrowReader(self.options["path"], int(self.options.get("task_bytes", TASK_BYTES)), list(schema.names))


def reachable(path: str) -> bool:
    try:
        opened(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def load(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The rows of an Arrow IPC file, or of all files of a folder, whose columns must agree.

    The schema and the batches of each file are read from its footer; of the rest the driver reads nothing. A task reads a run of
    batches of about `task_bytes`, one by one. A file without batches gives no rows.
    """
    spark.dataSource.register(ArrowSource)
    return spark.read.format(NAME).option("task_bytes", str(task_bytes)).load(path)
