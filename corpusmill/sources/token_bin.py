"""Token files: flat, headerless, little-endian unsigned 16-bit ids, as a Spark data source.

A path is one file, or a folder of parts whose order a manifest gives. Reading: one partition per byte range of each file or
part. Writing: each task streams its own part; the commit orders them by the position they start at, so
tasks may finish in any order, and a failed attempt leaves the stream as it was. Paths are opened through Arrow's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "file string, pos long, token int"
MANIFEST = "manifest.json"


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def parts_of(store: pa.fs.FileSystem, name: str) -> list:
    """[part, number of ids] of a folder, in order."""
    if store.get_file_info(f"{name}/{MANIFEST}").type == pa.fs.FileType.NotFound:
        return []
    with store.open_input_stream(f"{name}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class Range(InputPartition):
    path: str
    source: str
    start: int
    count: int
    pos: int


@dataclass
class Part(WriterCommitMessage):
    path: str
    first: int
    count: int


class TokenBin(DataSource):
    """format("token_bin"): options path (several joined by commas), range_tokens, flat (write one file instead of parts)."""

    @classmethod
    def name(cls) -> str:
        return "token_bin"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options["path"].split(","), int(self.options.get("range_tokens", 1 << 24)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options["path"], overwrite, str(self.options.get("flat", "false")).lower() == "true")


class Reader(DataSourceReader):
    def __init__(self, paths: list[str], range_tokens: int) -> None:
        self.paths, self.range_tokens = paths, range_tokens

    def partitions(self) -> list[Range]:
        found = []
        for path in self.paths:
            store, name = opened(path)
            info = store.get_file_info(name)
            if info.type == pa.fs.FileType.Directory:
                parts = [(f"{path}/{part}", n) for part, n in parts_of(store, name)]
            else:
                parts = [(path, info.size // 2)]
            before = 0
            for source, n in parts:
                found += [Range(path, source, s, min(self.range_tokens, n - s), before + s) for s in range(0, n, self.range_tokens)]
                before += n
        return found

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, name = opened(partition.source)
        with store.open_input_file(name) as f:
            for s in range(partition.start, partition.start + partition.count, 1 << 18):
                n = min(1 << 18, partition.start + partition.count - s)
                ids = np.frombuffer(f.read_at(2 * n, 2 * s), "<u2").astype(np.int32)
                first = partition.pos + s - partition.start
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array(np.arange(first, first + n)), pa.array(ids)], names=["file", "pos", "token"])


class Writer(DataSourceArrowWriter):
    """Rows (file, pos, token) of one file, range-partitioned and sorted by pos; ids outside 16 bits are an error.

    A task streams its batches to its part. A commit notes the parts in a manifest, so nothing passes through the driver;
    with ``flat`` it joins them to one file instead, for readers that know no manifest."""

    def __init__(self, path: str, overwrite: bool, flat: bool) -> None:
        self.path, self.overwrite, self.flat, self.stem = path, overwrite, flat, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        store, name = opened(f"{self.path}.{self.stem}-{uuid.uuid4().hex}.part" if self.flat else f"{self.path}/{self.stem}-{uuid.uuid4().hex}.part")
        out, first, last, n = None, 0, -1, 0
        try:
            for batch in batches:
                pos, ids = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pos", "token"))
                if not len(ids):
                    continue
                if ids.min() < 0 or ids.max() > 65_535:
                    raise ValueError("token id outside 0..65535")
                if pos[0] <= last or (np.diff(pos) <= 0).any():
                    raise ValueError("rows of a task must be sorted by pos")
                if out is None:
                    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
                    out, first = store.open_output_stream(name), int(pos[0])
                out.write(ids.astype("<u2").tobytes())
                last, n = int(pos[-1]), n + len(ids)
        finally:
            if out is not None:
                out.close()
        return Part(name if n else "", first, n)

    def commit(self, messages: list[Part | None]) -> None:
        store, name = opened(self.path)
        parts = sorted((m for m in messages if m and m.count), key=lambda m: m.first)
        if not self.flat:
            old = [] if self.overwrite else parts_of(store, name)
            store.create_dir(name, recursive=True)
            temporary = f"{name}/{self.stem}.manifest"
            with store.open_output_stream(temporary) as out:
                out.write(json.dumps(old + [[p.path.rsplit("/", 1)[1], p.count] for p in parts]).encode())
            store.move(temporary, f"{name}/{MANIFEST}")
            return
        temporary = f"{name}.{self.stem}"
        with store.open_output_stream(temporary) as out:
            old = [] if self.overwrite or store.get_file_info(name).type == pa.fs.FileType.NotFound else [name]
            for part in old + [p.path for p in parts]:
                with store.open_input_stream(part) as f:
                    while piece := f.read(1 << 24):
                        out.write(piece)
        store.move(temporary, name)
        for p in parts:
            store.delete_file(p.path)

    def abort(self, messages: list[Part | None]) -> None:
        store, _ = opened(self.path)
        for m in messages:
            if m and m.count:
                store.delete_file(m.path)
