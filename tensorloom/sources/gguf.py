"""GGUF version 3 with Q8_0 tensors.

write_chunks() takes a tensor as chunks: executors quantize them to blocks and encode the
bytes, the driver streams those into the file. format("gguf") reads tensors as block rows;
its partitions are byte ranges of whole blocks. encode() and read() are the same for values
and bytes held in memory. Paths must be readable where the executors run.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import blocks, parts
from ..operators.quantize import check_q8_0, q8_0_shape
from ..schema import CATALOG, Q8_BLOCK, Q8_BLOCK_BYTES, TensorError
from .safetensors import to_bytes, write_atomically

#: Format constants (fixed values).
MAGIC, VERSION, ALIGNMENT, UINT32, STRING, Q8_0 = b"GGUF", 3, 32, 4, 8, 8
KEYS = {"general.alignment": ALIGNMENT, "general.quantization_version": 2, "general.file_type": 7}


@dataclass(frozen=True)
class GgufTensor:
    name: str
    shape: tuple[int, ...]
    ggml_type: int
    offset: int
    byte_len: int


@dataclass(frozen=True)
class GgufHeader:
    version: int
    metadata: dict[str, object]
    alignment: int
    data_offset: int
    file_size: int
    tensors: tuple[GgufTensor, ...]


def quantize_blocks(values: np.ndarray) -> bytes:
    """34-byte blocks: a binary16 scale and 32 values, by the float32 reciprocal of the exact scale."""
    x = np.asarray(values, "<f4").reshape(-1, Q8_BLOCK)
    bad = np.flatnonzero(~np.isfinite(x.ravel()))
    if len(bad):
        raise TensorError("NonFiniteInput", f"index {bad[0]}")
    scale = (np.abs(x).max(1) / np.float32(127)).astype("<f4")
    with np.errstate(divide="ignore", over="ignore"):
        inverse = np.where(scale == 0, np.float32(0), np.float32(1) / scale).astype("<f4")
        stored = scale.astype("<f2")
    if not np.isfinite(stored).all() or not np.isfinite(inverse).all():
        raise TensorError("InvalidScale", "a block's scale has no binary16 value")
    y = (x * inverse[:, None]).astype("<f4").astype(np.float64)
    q = np.clip(np.sign(y) * np.floor(np.abs(y) + 0.5), -127, 127).astype(np.int8)
    return np.concatenate([stored.view(np.uint8).reshape(-1, 2), q.view(np.uint8)], 1).tobytes()


def dequantize_blocks(raw: bytes) -> np.ndarray:
    if not raw or len(raw) % Q8_BLOCK_BYTES:
        raise TensorError("InvalidDataLength", str(len(raw)))
    b = np.frombuffer(raw, np.uint8).reshape(-1, Q8_BLOCK_BYTES)
    scale = np.ascontiguousarray(b[:, :2]).view("<f2").astype("<f4")
    return (np.ascontiguousarray(b[:, 2:]).view(np.int8).astype("<f4") * scale).ravel()


def _string(x: str) -> bytes:
    raw = x.encode()
    return struct.pack("<Q", len(raw)) + raw


def _head(name: str, shape: list[int]) -> bytes:
    if not name:
        raise TensorError("InvalidTensorName", name)
    out = MAGIC + struct.pack("<IQQ", VERSION, 1, len(KEYS))
    for k, v in KEYS.items():
        out += _string(k) + struct.pack("<II", UINT32, v)
    out += _string(name) + struct.pack("<I", len(shape)) + struct.pack(f"<{len(shape)}Q", *reversed(shape)) + struct.pack("<IQ", Q8_0, 0)
    return out + bytes(-len(out) % ALIGNMENT)


def encode(name: str, shape: list[int], values: np.ndarray) -> bytes:
    """The whole file; the same input always gives the same bytes."""
    total = q8_0_shape(shape)
    if total != len(values):
        raise TensorError("LengthMismatch", f"{len(values)} values for {shape}")
    head, body = _head(name, shape), quantize_blocks(values)
    return head + body + bytes(-len(body) % ALIGNMENT)


def write(path: str, name: str, shape: list[int], values: np.ndarray) -> None:
    write_atomically(path, iter([encode(name, shape, values)]))


def write_chunks(path: str, name: str, shape: list[int], chunks: DataFrame) -> None:
    """Write one tensor from its chunks (tensor, base_idx, vals), each of whole blocks, in any order."""
    head, tops = _head(name, shape), blocks.tops(chunks)
    found = tops.agg(F.count("*"), F.sum("n")).first()
    if found[0] > 1 or (found[1] or 0) != q8_0_shape(shape):
        raise TensorError("LengthMismatch", f"{found[1]} values in {found[0]} tensors for {shape}")
    if not chunks.filter((F.col("base_idx") % Q8_BLOCK != 0) | (F.size("vals") % Q8_BLOCK != 0)).isEmpty():
        raise TensorError("InvalidChunkSize", f"chunks must hold whole blocks of {Q8_BLOCK}")
    check_q8_0(tops)
    size = found[1] // Q8_BLOCK * Q8_BLOCK_BYTES
    rows = to_bytes(chunks.select("tensor", F.col("base_idx").alias("chunk"), parts.q8_0_data().alias("data")), "data", "u1").orderBy("chunk")

    def pieces() -> Iterator[bytes]:
        yield head
        for r in rows.toLocalIterator():
            yield bytes(r.bytes)
        yield bytes(-size % ALIGNMENT)

    write_atomically(path, pieces(), len(head) + size + -size % ALIGNMENT)


class Cursor:
    """Bounds-checked little-endian reads."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if n > len(self.raw) - self.at:
            raise TensorError("Malformed", "the file ends too early")
        self.at += n
        return self.raw[self.at - n : self.at]

    def u32(self) -> int:
        return struct.unpack("<I", self.take(4))[0]

    def u64(self) -> int:
        return struct.unpack("<Q", self.take(8))[0]

    def string(self) -> str:
        try:
            return self.take(self.u64()).decode("utf-8")
        except UnicodeDecodeError as e:
            raise TensorError("Malformed", "a string is not UTF-8") from e


def inspect(raw: bytes, size: int | None = None) -> GgufHeader:
    """The checked header of a file's first bytes; size: those of the whole file, if there are more."""
    size = len(raw) if size is None else size
    c = Cursor(raw)
    if c.take(4) != MAGIC:
        raise TensorError("Malformed", "no GGUF magic")
    version = c.u32()
    if version != VERSION:
        raise TensorError("UnsupportedVersion", str(version))
    tensors, pairs = c.u64(), c.u64()
    if max(tensors, pairs) > size:
        raise TensorError("Malformed", "more entries than bytes")
    notes: dict[str, object] = {}
    for _ in range(pairs):
        key, kind = c.string(), c.u32()
        if kind not in (UINT32, STRING):
            raise TensorError("UnsupportedMetadataType", f"{key}: {kind}")
        if key in notes:
            raise TensorError("Malformed", f"{key} stands twice")
        notes[key] = c.u32() if kind == UINT32 else c.string()
    for k in KEYS:
        if not isinstance(notes.get(k), int):
            raise TensorError("Malformed", f"{k} is missing")
    alignment = notes["general.alignment"]
    if alignment < 1 or alignment & (alignment - 1):
        raise TensorError("Malformed", f"alignment {alignment}")
    found, names = [], set()
    for _ in range(tensors):
        name, rank = c.string(), c.u32()
        if not name or name in names:
            raise TensorError("InvalidTensorName", name)
        names.add(name)
        if not rank or rank > size:
            raise TensorError("Malformed", f"{name}: rank {rank}")
        shape = tuple(reversed([c.u64() for _ in range(rank)]))
        kind, offset = c.u32(), c.u64()
        if kind != Q8_0:
            raise TensorError("UnsupportedTensorType", str(kind))
        if 0 in shape or shape[-1] % Q8_BLOCK or offset % alignment:
            raise TensorError("Malformed", f"{name}: shape {shape} at {offset}")
        found.append(GgufTensor(name, shape, kind, offset, q8_0_shape(list(shape)) // Q8_BLOCK * Q8_BLOCK_BYTES))
    start = -(-c.at // alignment) * alignment
    end = 0
    for t in sorted(found, key=lambda t: t.offset):
        if t.offset < end or start + t.offset + t.byte_len > size:
            raise TensorError("Malformed", f"{t.name}: its data overlaps or lies outside")
        end = t.offset + t.byte_len
    return GgufHeader(version, notes, alignment, start, size, tuple(found))


def read(raw: bytes) -> tuple[GgufHeader, bytes]:
    """The header and the blocks of the one tensor."""
    h = inspect(raw)
    if len(h.tensors) != 1:
        raise TensorError("Malformed", f"{len(h.tensors)} tensors")
    t = h.tensors[0]
    return h, raw[h.data_offset + t.offset : h.data_offset + t.offset + t.byte_len]


#: Largest part of a file that holds its header.
HEADER_BYTES = 64 << 20
#: Blocks that one input partition reads, and those in a batch.
PARTITION_BLOCKS, BATCH_BLOCKS = 1 << 20, 1 << 14
BLOCKS = "tensor string, block bigint, scale float, qs array<tinyint>"


def read_header(path: str) -> GgufHeader:
    """The checked header of a file; its payloads are not read."""
    try:
        size = os.path.getsize(path)
        with open(path, "rb") as f:
            return inspect(f.read(HEADER_BYTES), size)
    except OSError as e:
        raise TensorError("Io", str(e)) from e


@dataclass
class Span(InputPartition):
    path: str
    tensor: str
    offset: int
    first: int
    blocks: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, tensor: str | None):
        self.path, self.tensor = path, tensor

    def partitions(self) -> list[Span]:
        h = read_header(self.path)
        if self.tensor is not None and self.tensor not in {t.name for t in h.tensors}:
            raise TensorError("TensorNotFound", self.tensor)
        out = []
        for t in h.tensors:
            if self.tensor in (None, t.name):
                total = t.byte_len // Q8_BLOCK_BYTES
                out += [Span(self.path, t.name, h.data_offset + t.offset + k * Q8_BLOCK_BYTES, k, min(PARTITION_BLOCKS, total - k)) for k in range(0, total, PARTITION_BLOCKS)]
        return out or [Span(self.path, "", 0, 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        with open(span.path, "rb") as f:
            f.seek(span.offset)
            for k in range(0, span.blocks, BATCH_BLOCKS):
                n = min(BATCH_BLOCKS, span.blocks - k)
                raw = np.frombuffer(f.read(n * Q8_BLOCK_BYTES), np.uint8).reshape(n, Q8_BLOCK_BYTES)
                scale = np.ascontiguousarray(raw[:, :2]).view("<f2").astype("<f4").ravel()
                values = pa.array(np.ascontiguousarray(raw[:, 2:]).view(np.int8).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * Q8_BLOCK, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([pa.array([span.tensor] * n, pa.string()), pa.array(np.arange(n) + span.first + k, pa.int64()), pa.array(scale), lists], ["tensor", "block", "scale", "qs"])


class GgufSource(DataSource):
    """format("gguf"): options path and tensor; rows are Q8_0 blocks."""

    @classmethod
    def name(cls) -> str:
        return "gguf"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("tensor"))


def read_blocks(spark: SparkSession, path: str, tensor: str | None = None) -> DataFrame:
    """(tensor, block, scale, qs) of a file's tensors, or of one."""
    spark.dataSource.register(GgufSource)
    reader = spark.read.format("gguf")
    return (reader if tensor is None else reader.option("tensor", tensor)).load(path)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """A row for each tensor; offsets are relative to the data section."""
    h = read_header(path)
    rows = [(path, t.name, "Q8_0", list(t.shape), q8_0_shape(list(t.shape)), t.byte_len, t.offset, t.offset + t.byte_len) for t in h.tensors]
    return spark.createDataFrame(rows, CATALOG)


def read_file(path: str) -> tuple[GgufHeader, bytes]:
    if not os.path.exists(path):
        raise TensorError("Io", path)
    with open(path, "rb") as f:
        return read(f.read())
