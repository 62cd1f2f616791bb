"""Packed half-precision vector matrices as a data source.

A matrix is a file ``name.bin`` of fixed-width rows and a file ``name.json`` with ``dim``, ``count`` and ``ids`` in row order.
A folder may hold many of them. Tasks read byte ranges; neither matrices nor id lists pass through the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "packed_vectors"
RANGE_BYTES = 8 << 20
BATCH_ROWS = 4096


@dataclass
class ByteRange(InputPartition):
    blob: str
    sidecar: str
    start: int
    stop: int


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


def _located(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


class PackedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.sidecar = options.get("sidecar")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[ByteRange]:
        """Byte ranges of all matrices. A row belongs to the range that its first byte lies in."""
        system, root = _located(self.path)
        if self.sidecar:
            found = [(self.path, self.sidecar, system.get_file_info(root).size)]
        else:
            files = system.get_file_info(fs.FileSelector(root))
            base = self.path.rstrip("/")
            found = [(f"{base}/{f.base_name}", f"{base}/{f.base_name[:-4]}.json", f.size) for f in files if f.extension == "bin"]
        return [
            ByteRange(blob, sidecar, start, min(start + self.range_bytes, size))
            for blob, sidecar, size in sorted(found) for start in range(0, max(size, 1), self.range_bytes)
        ]

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without matrices
            return
        system, path = _located(partition.sidecar)
        with system.open_input_stream(path) as stream:
            meta = json.loads(stream.read())
        width = int(meta["dim"]) * 2
        system, path = _located(partition.blob)
        with system.open_input_file(path) as blob:
            if blob.size() != width * int(meta["count"]) or len(meta["ids"]) != int(meta["count"]):
                raise ValueError(f"{partition.blob} holds {blob.size()} bytes, {len(meta['ids'])} ids; expected {meta['count']} rows of {width} bytes")
            if not width:
                return
            first, last = -(-partition.start // width), -(-partition.stop // width)
            for at in range(first, last, BATCH_ROWS):
                n = min(BATCH_ROWS, last - at)
                flat = np.frombuffer(blob.read_at(n * width, at * width), "<f2").astype(np.float32)
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (width // 2))
                ids = pa.array([str(x) for x in meta["ids"][at : at + n]], pa.string())
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, pa.array(flat))], ["id", "vector"])


class PackedWriter(DataSourceArrowWriter):
    """One matrix per task, or more where ``rows`` limits them. Files of failed tasks are deleted, or have names nobody reads."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.rows = int(options.get("rows", 1 << 16))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _located(self.path)
        system.create_dir(root, recursive=True)
        names: list[str] = []
        ids: list[str] = []
        parts: list[np.ndarray] = []

        def close() -> None:
            if not ids:
                return
            name, matrix = f"part-{uuid.uuid4().hex}", np.concatenate(parts)
            with system.open_output_stream(f"{root}/{name}.bin.new") as out:
                out.write(matrix.tobytes())
            with system.open_output_stream(f"{root}/{name}.json") as out:
                out.write(json.dumps({"dim": len(matrix) // len(ids), "count": len(ids), "ids": ids}).encode())
            names.append(name)
            ids.clear()
            parts.clear()

        dim = None
        for batch in iterator:
            for at in range(0, batch.num_rows, self.rows):
                piece = batch.slice(at, self.rows)
                if len(ids) + piece.num_rows > self.rows:
                    close()
                vectors = piece.column("vector")
                sizes = set(vectors.value_lengths().to_pylist())
                dim = dim or max(sizes - {None}, default=None)
                if sizes - {dim} or vectors.flatten().null_count:
                    raise ValueError(f"vectors of one length without nulls are asked for, found lengths {sorted(map(str, sizes))}")
                ids.extend(str(x) for x in piece.column("id").to_pylist())
                parts.append(vectors.flatten().to_numpy(zero_copy_only=False).astype("<f2"))
        close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _located(self.path)
        system.create_dir(root, recursive=True)
        new = {n for m in messages if m for n in m.names}
        for name in new:
            system.move(f"{root}/{name}.bin.new", f"{root}/{name}.bin")
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(root)):
                if f.base_name.startswith("part-") and f.base_name.split(".")[0] not in new:
                    system.delete_file(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _located(self.path)
        for name in (n for m in messages if m for n in m.names):
            system.delete_file(f"{root}/{name}.bin.new")
            system.delete_file(f"{root}/{name}.json")


class PackedVectors(DataSource):
    """``id string, vector array<float>``. Options: ``sidecar`` for a single matrix, ``rangeBytes`` per task, ``rows`` per written matrix."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "id string, vector array<float>"

    def reader(self, schema: StructType) -> PackedReader:
        return PackedReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> PackedWriter:
        return PackedWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackedVectors)
