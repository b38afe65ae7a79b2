"""One Arrow IPC stream in gzip parts that are byte ranges of it, as a Spark data source named ``arrowparts``."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusloom.sources import files

# What errors say that only concern the end marks after the last batch.
FOOTERS = (
    "Expected to be able to read", "Invalid flatbuffers message", "Invalid IPC stream: negative continuation token",
    "Tried reading schema message, was null or length 0",
)


class Chained(io.RawIOBase):
    """The unpacked bytes of several gzip files, one after the other."""

    def __init__(self, paths: list[str]) -> None:
        self._paths, self._file = list(paths), None

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            if self._file is None:
                if not self._paths:
                    return 0
                system, inner = files.of(self._paths.pop(0))
                self._file = gzip.GzipFile(fileobj=system.open_input_file(inner))
            n = self._file.readinto(buffer)
            if n:
                return n
            self._file.close()
            self._file = None


def batches(paths: list[str]) -> Iterator[pa.RecordBatch]:
    """The batches of the stream; a broken footer after all parts were read is tolerated once a row was seen.

    Any other error, and a broken place before the end, is raised: rows after it would be lost.
    """
    source = io.BufferedReader(Chained(paths), 1 << 20)
    reader = pa.ipc.open_stream(source)
    seen = 0
    while True:
        try:
            batch = reader.read_next_batch()
        except StopIteration:
            return
        except (pa.ArrowInvalid, OSError) as e:
            if seen and not source.peek(1) and any(x in str(e) for x in FOOTERS):
                return
            raise
        seen += batch.num_rows
        yield batch


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.paths, self.names = files.listed(options["path"]), [f.name for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # the parts are one stream; repartition right after

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for batch in batches(self.paths):
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in self.names], names=self.names)


class ArrowParts(DataSource):
    """Options: ``path`` (a glob); the schema is that of ``spark.read.schema``."""

    @classmethod
    def name(cls) -> str:
        return "arrowparts"

    def schema(self) -> str:
        raise ValueError("arrowparts needs an explicit schema")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, schema)
