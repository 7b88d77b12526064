"""SafeTensors: a u64 header length, a JSON header, then the payloads; one file, or several under an index.

The header is read and checked on the driver (metadata only). Payloads are read by a Python
data source whose partitions are byte ranges of whole chunks; tensors that aren't asked for by
name are never opened. Where the session lets Python sources have filters, a filter on the
name does the same. Paths must be readable where the executors run.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..schema import CATALOG, CHUNK_ELEMENTS, CHUNKS, DTYPE_BITS, FLOATING, PAYLOAD, TensorError, byte_length, element_count

#: Largest header (fixed value).
MAX_HEADER = 100_000_000
#: Chunks that one input partition reads (64 MiB of float32).
PARTITION_CHUNKS = 1024
#: Bytes of a batch that an encoder hands on; a longer row makes a batch of its own.
PIECE_BYTES = 1 << 22
#: Integer types that can be read, and their numpy storage.
INTEGERS = {"I8": "i1", "I16": "<i2", "I32": "<i4", "I64": "<i8"}
#: Columns by mode of the data source.
MODES = {"chunks": CHUNKS, "payload": PAYLOAD, "codes": "tensor string, chunk bigint, qs array<tinyint>", "integers": "tensor string, chunk bigint, vals array<bigint>"}


@dataclass(frozen=True)
class Tensor:
    name: str
    dtype: str
    shape: tuple[int, ...]
    start: int  # relative to the data section
    end: int

    @property
    def byte_len(self) -> int:
        return self.end - self.start

    @property
    def count(self) -> int:
        return element_count(list(self.shape))


@dataclass(frozen=True)
class Header:
    path: str
    file_size: int
    data_start: int
    tensors: tuple[Tensor, ...]

    def tensor(self, name: str) -> Tensor:
        for t in self.tensors:
            if t.name == name:
                return t
        raise TensorError("TensorNotFound", name)

    def place(self, t: Tensor) -> tuple[str, int]:
        """The file that holds a tensor, and where its payload begins there."""
        return self.path, self.data_start + t.start

    @property
    def files(self) -> list[str]:
        return [self.path]


@dataclass(frozen=True)
class Sharded(Header):
    """An index and its shards as one input: tensors in name order, file_size of all shards."""

    shards: dict[str, Header]  # by tensor

    def place(self, t: Tensor) -> tuple[str, int]:
        return self.shards[t.name].place(t)

    @property
    def files(self) -> list[str]:
        return sorted({h.path for h in self.shards.values()})


def _whole(x: object) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and 0 <= x < 1 << 64


def _entry(name: str, spec: object) -> Tensor:
    bad = lambda why: TensorError("InvalidMetadata", f"{name}: {why}")
    if not isinstance(spec, dict):
        raise bad("not an object")
    dtype, shape, offsets = spec.get("dtype"), spec.get("shape"), spec.get("data_offsets")
    if dtype not in DTYPE_BITS:
        raise bad(f"unknown dtype {dtype}")
    if not isinstance(shape, list) or not all(map(_whole, shape)):
        raise bad("shape must be unsigned integers")
    if not isinstance(offsets, list) or len(offsets) != 2 or not all(map(_whole, offsets)) or offsets[0] > offsets[1]:
        raise bad("data_offsets must be two ascending unsigned integers")
    if byte_length(dtype, shape) != offsets[1] - offsets[0]:
        raise bad("byte length differs from shape and dtype")
    return Tensor(name, dtype, tuple(shape), *offsets)


def parse_header(raw: bytes, data_bytes: int) -> tuple[Tensor, ...]:
    """Tensors by data offset; they must lie without gaps and fill the data section."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError as e:
        raise TensorError("InvalidHeaderUtf8", str(e)) from e
    try:
        root = json.loads(text)
    except ValueError as e:
        raise TensorError("InvalidHeaderJson", str(e)) from e
    if not isinstance(root, dict):
        raise TensorError("InvalidHeaderJson", "not an object")
    notes = root.pop("__metadata__", {})
    if not isinstance(notes, dict) or not all(isinstance(v, str) for v in notes.values()):
        raise TensorError("InvalidMetadata", "__metadata__ must map to strings")
    tensors = sorted((_entry(k, v) for k, v in root.items()), key=lambda t: (t.start, t.end, t.name.encode()))
    at = 0
    for t in tensors:
        if t.start != at:
            raise TensorError("InvalidMetadata", f"{t.name}: gap or overlap at {at}")
        at = t.end
    if at != data_bytes:
        raise TensorError("MetadataIncompleteBuffer", f"{at} bytes described, {data_bytes} there")
    return tuple(tensors)


def read_header(path: str) -> Header:
    """The checked header of a file; payloads are not read."""
    try:
        size = os.path.getsize(path)
        with open(path, "rb") as f:
            head = f.read(8)
            if len(head) < 8:
                raise TensorError("HeaderTooSmall", path)
            n = struct.unpack("<Q", head)[0]
            if n > MAX_HEADER:
                raise TensorError("HeaderTooLarge", str(n))
            if 8 + n > size:
                raise TensorError("MetadataIncompleteBuffer", f"header of {n} bytes in a file of {size}")
            raw = f.read(n)
    except OSError as e:
        raise TensorError("Io", str(e)) from e
    return Header(path, size, 8 + n, parse_header(raw, size - 8 - n))


def _shard_names(path: str) -> tuple[dict[str, str], int | None]:
    """(file name by tensor, total size or None) of an index; members it doesn't define are ignored."""
    bad = lambda why: TensorError("InvalidIndex", f"{path}: {why}")
    repeating: list[dict] = []

    def members(pairs: list[tuple[str, object]]) -> dict[str, object]:
        out = dict(pairs)
        if len(out) != len(pairs):
            repeating.append(out)
        return out

    try:
        with open(path, "rb") as f:
            root = json.loads(f.read().decode("utf-8"), object_pairs_hook=members)
    except OSError as e:
        raise TensorError("Io", str(e)) from e
    except (ValueError, RecursionError) as e:
        raise bad(str(e)) from e
    if not isinstance(root, dict) or not isinstance(names := root.get("weight_map"), dict):
        raise bad("no weight_map")
    if any(x is root or x is names for x in repeating):
        raise TensorError("DuplicateTensor", f"{path}: a name stands twice")
    if "__metadata__" in names:
        raise bad("__metadata__ is no tensor")
    for tensor, name in names.items():
        if not isinstance(name, str) or not name:
            raise bad(f"{tensor}: no file name")
        if name in (".", "..") or re.search(r"[/\\\0]|^[A-Za-z]:", name):
            raise TensorError("UnsafeShard", f"{path}: {tensor}: {name!r}")
    notes = root.get("metadata", {})
    if not isinstance(notes, dict) or "total_size" in notes and not _whole(notes["total_size"]):
        raise bad("metadata")
    return names, notes.get("total_size")


def read_index(path: str) -> Sharded:
    """The checked headers of all shards of an index; they lie beside it and hold just its tensors, each once."""
    names, total = _shard_names(path)
    headers: dict[str, Header] = {}
    for name in sorted(set(names.values())):
        file = os.path.join(os.path.dirname(path), name)
        if not os.path.isfile(file):
            raise TensorError("MissingShard", f"{path}: {file}")
        try:
            headers[name] = read_header(file)
        except TensorError as e:
            raise TensorError("InvalidShard", f"{path}: {file}: {e}") from e
    found = [(t, name) for name, h in headers.items() for t in h.tensors]
    owner = {t.name: name for t, name in found}
    if len(owner) != len(found):
        raise TensorError("DuplicateTensor", f"{path}: shards share a tensor")
    if owner != names:
        odd = min(k for k in owner.keys() | names.keys() if owner.get(k) != names.get(k))
        raise TensorError("ShardTensorMismatch", f"{path}: {odd} in {names.get(odd)} by the index, in {owner.get(odd)} by the shards")
    size = sum(t.byte_len for t, _ in found)
    if total is not None and total != size:
        raise TensorError("TotalSizeMismatch", f"{path}: {total} bytes by the index, {size} in the shards")
    tensors = tuple(sorted((t for t, _ in found), key=lambda t: t.name.encode()))
    return Sharded(path, sum(h.file_size for h in headers.values()), 0, tensors, {k: headers[v] for k, v in owner.items()})


def open_input(path: str) -> Header:
    """A file, an index (*.index.json), or a folder with one index or else one file; nothing is searched below it."""
    if os.path.isdir(path):
        names = sorted(n for n in os.listdir(path) if os.path.isfile(os.path.join(path, n)))
        found = [n for n in names if n.endswith(".safetensors.index.json")] or [n for n in names if n.endswith(".safetensors")]
        if len(found) != 1:
            raise TensorError("AmbiguousInput", f"{path}: {', '.join(found) or 'no SafeTensors file'}")
        path = os.path.join(path, found[0])
    elif os.path.exists(path) and not os.path.isfile(path):
        raise TensorError("InvalidInput", f"{path}: neither a file nor a folder")
    return read_index(path) if path.endswith(".index.json") else read_header(path)


def catalog(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per tensor, in data order within a file, in name order under an index; path is the file that holds it."""
    rows = [(h.place(t)[0], t.name, t.dtype, list(t.shape), t.count, t.byte_len, t.start, t.end) for h in map(open_input, paths) for t in h.tensors]
    return spark.createDataFrame(rows, CATALOG)


def decode(raw: bytes, dtype: str) -> np.ndarray:
    """Little-endian F32, F16 or BF16 bytes as float32."""
    if dtype not in FLOATING:
        raise TensorError("UnsupportedTensorDtype", dtype)
    x = np.frombuffer(raw, FLOATING[dtype])
    return (x.astype("<u4") << 16).view("<f4") if dtype == "BF16" else x.astype("<f4")


def _listed(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One row that holds all of x."""
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))


@dataclass
class Span(InputPartition):
    path: str
    tensor: str
    dtype: str
    offset: int
    first_chunk: int
    chunks: int
    bytes: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, mode: str, chunk: int, tensors: list[str] | None):
        self.path, self.mode, self.typed, self.chunk = path, mode, mode == "chunks", chunk
        self.names = None if tensors is None else set(tensors)

    def partitions(self) -> list[Span]:
        header, out = open_input(self.path), []
        for t in header.tensors:
            if self.names is not None and t.name not in self.names or self.typed and t.dtype not in FLOATING:
                continue
            width = DTYPE_BITS[t.dtype] // 8 if self.typed else 4
            step = self.chunk * width  # bytes of a chunk
            total, (path, at) = -(-t.byte_len // step), header.place(t)
            for k in range(0, total, PARTITION_CHUNKS):
                n = min(PARTITION_CHUNKS, total - k)
                out.append(Span(path, t.name, t.dtype, at + k * step, k, n, min(n * step, t.byte_len - k * step)))
        return out or [Span(self.path, "", "F32", 0, 0, 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if not span.chunks:  # no tensor was asked for: the path may be a folder
            return
        width = DTYPE_BITS[span.dtype] // 8 if self.typed else 4
        step = self.chunk * width
        with open(span.path, "rb") as f:
            f.seek(span.offset)
            for k in range(span.chunks):
                raw = f.read(min(step, span.bytes - k * step))
                n = span.first_chunk + k
                if self.typed:
                    x = decode(raw, span.dtype)
                    yield pa.RecordBatch.from_arrays([pa.array([span.tensor]), pa.array([n], pa.int64()), pa.array([n * self.chunk], pa.int64()), _listed(x, pa.float32())], ["tensor", "chunk", "base_idx", "vals"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([span.tensor]), pa.array([n], pa.int64()), self._held(raw, span.dtype)], ["tensor", "chunk", {"codes": "qs", "integers": "vals"}.get(self.mode, "bytes")])

    def _held(self, raw: bytes, dtype: str) -> pa.Array:
        """The bytes of a chunk as the mode has them."""
        if self.mode == "codes":
            return _listed(np.frombuffer(raw, np.int8), pa.int8())
        if self.mode == "integers":
            return _listed(np.frombuffer(raw, INTEGERS[dtype]).astype(np.int64), pa.int64())
        return pa.array([raw], pa.binary())


class _PushingReader(_Reader):
    """Takes filters on the tensor's name; only for sessions that let Python sources have filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            names = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if names is not None and f.attribute == ("tensor",):
                self.names = names if self.names is None else self.names & names
            else:
                yield f


class SafetensorsSource(DataSource):
    """format("safetensors"): options path, mode (of MODES), chunk (elements), tensors (JSON list of names).

    pushdown: "true" where spark.sql.python.filterPushdown.enabled is; the session's setting is left as it is.
    """

    @classmethod
    def name(cls) -> str:
        return "safetensors"

    def schema(self) -> str:
        return MODES[self.options.get("mode", "chunks")]

    def reader(self, schema: object) -> DataSourceReader:
        kind = _PushingReader if self.options.get("pushdown") == "true" else _Reader
        names = self.options.get("tensors")
        return kind(self.options["path"], self.options.get("mode", "chunks"), int(self.options.get("chunk", CHUNK_ELEMENTS)), None if names is None else json.loads(names))


def chunks(spark: SparkSession, path: str, chunk: int = CHUNK_ELEMENTS, tensor: str | None = None, tensors: list[str] | None = None) -> DataFrame:
    """Float tensors as chunks of values. A named tensor must be there and readable as float32; others of tensors are not read."""
    if tensor is not None and (t := open_input(path).tensor(tensor)).dtype not in FLOATING:
        raise TensorError("UnsupportedTensorDtype", t.dtype)
    return _load(spark, path, "chunks", chunk, [tensor] if tensor is not None else tensors)


def payload(spark: SparkSession, path: str, tensor: str | None = None, chunk: int = CHUNK_ELEMENTS, tensors: list[str] | None = None) -> DataFrame:
    """Any tensor as consecutive byte chunks of four bytes an element."""
    if tensor is not None:
        open_input(path).tensor(tensor)
    return _load(spark, path, "payload", chunk, [tensor] if tensor is not None else tensors)


def codes(spark: SparkSession, path: str, tensors: list[str], chunk: int = CHUNK_ELEMENTS) -> DataFrame:
    """(tensor, chunk, qs array<tinyint>) of I8 tensors; chunk: a multiple of four elements."""
    header = open_input(path)
    for name in tensors:
        if header.tensor(name).dtype != "I8":
            raise TensorError("UnsupportedTensorDtype", header.tensor(name).dtype)

    return _load(spark, path, "codes", chunk // 4, tensors)


def integers(spark: SparkSession, path: str, tensors: list[str]) -> DataFrame:
    """(tensor, chunk, vals array<bigint>) of integer tensors."""
    header = open_input(path)
    for name in tensors:
        if header.tensor(name).dtype not in INTEGERS:
            raise TensorError("UnsupportedTensorDtype", f"{name}: {header.tensor(name).dtype}")
    return _load(spark, path, "integers", CHUNK_ELEMENTS, tensors)


def _load(spark: SparkSession, path: str, mode: str, chunk: int, tensors: list[str] | None) -> DataFrame:
    spark.dataSource.register(SafetensorsSource)
    reader = spark.read.format("safetensors").option("mode", mode).option("chunk", str(chunk))
    reader = reader.option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    if tensors is not None:
        reader = reader.option("tensors", json.dumps(tensors))
    return reader.load(path)


def to_bytes(rows: DataFrame, values: str, storage: str) -> DataFrame:
    """(tensor, chunk, bytes): arrays as little-endian bytes of a numpy type, encoded where the rows are.

    The bytes are the arrays' own memory where the types are the same, and a piece's copy where they aren't.
    """
    width = np.dtype(storage).itemsize

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ends, i = b.column(2).offsets.to_numpy(), 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(ends, int(ends[i]) + PIECE_BYTES // width, "right")) - 1)
                piece = b.slice(i, j - i)
                flat = piece.column(2).flatten().to_numpy(zero_copy_only=False).astype(storage, copy=False)
                at = pa.array((ends[i : j + 1].astype(np.int64) - ends[i]) * width, pa.int32())
                own = pa.Array.from_buffers(pa.binary(), piece.num_rows, [None, at.buffers()[1], pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), own], ["tensor", "chunk", "bytes"])
                i = j

    return rows.select(F.col("tensor").cast("string"), F.col("chunk").cast("long"), values).mapInArrow(batches, PAYLOAD)


def frame(header: dict[str, object]) -> bytes:
    """Length, compact JSON with sorted keys, spaces up to a multiple of eight."""
    try:
        raw = json.dumps(header, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
    except (TypeError, ValueError) as e:  # a name that isn't Unicode text, a value that isn't JSON
        raise TensorError("Serialization", str(e)) from e
    raw += b" " * (-len(raw) % 8)
    if len(raw) > MAX_HEADER:
        raise TensorError("HeaderTooLarge", str(len(raw)))
    return struct.pack("<Q", len(raw)) + raw


def manifest(catalog_rows: list, decisions: dict[str, str], namespace: str) -> str:
    """What became of each tensor, as compact JSON with sorted keys (fixed format)."""
    out = {}
    for t in catalog_rows:
        record = {"original_dtype": t.dtype, "original_shape": list(t.shape)}
        if decisions[t.tensor] == "quantize":
            record |= {"action": "quantized", "qdata_dtype": "I8", "qdata_name": f"{t.tensor}.qdata", "scale_dtype": "F32", "scale_name": f"{t.tensor}.scale", "scale_shape": []}
        else:
            record |= {"action": "preserved", "tensor_name": t.tensor}
        out[t.tensor] = record
    return json.dumps({"schema": f"{namespace}.int8.manifest.v1", "tensors": out}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def metadata(manifest_json: str, namespace: str) -> dict[str, str]:
    """The file's metadata; keys carry the namespace (fixed format)."""
    own = {"algorithm": "max-abs-scale-v0", "format": f"{namespace}-native", "format_version": "1", "manifest": manifest_json, "quantization": "int8", "qmax": "127", "qmin": "-127", "rounding": "ties-away-from-zero", "scheme": "symmetric-per-tensor"}
    return {f"{namespace}.{k}": v for k, v in own.items()}


def write_atomically(destination: str, parts: Iterator[bytes], expected: int | None = None) -> None:
    """A temporary file beside the destination, synced and renamed; never over an existing file."""
    if os.path.exists(destination):
        raise TensorError("DestinationExists", destination)
    folder = os.path.dirname(os.path.abspath(destination))
    if not os.path.isdir(folder) or not os.path.basename(destination):
        raise TensorError("InvalidDestination", destination)
    temporary = os.path.join(folder, f".{os.path.basename(destination)}.{uuid.uuid4().hex}.tmp")
    try:
        written = 0
        with open(temporary, "xb") as f:
            for part in parts:
                written += f.write(part)
            f.flush()
            os.fsync(f.fileno())
        if expected is not None and written != expected:
            raise TensorError("DataLengthMismatch", f"{written} bytes, {expected} planned")
        if os.path.exists(destination):
            raise TensorError("DestinationExists", destination)
        os.rename(temporary, destination)
    finally:
        if os.path.exists(temporary):
            os.remove(temporary)


def write(source: str, destination: str, plan: DataFrame, decisions: DataFrame, quantized: DataFrame, scales: DataFrame, replan: DataFrame | None = None, namespace: str = "tensorloom") -> None:
    """Write the planned file.

    quantized: (tensor, chunk, qs array<tinyint>); scales: (tensor, scale). Executors do
    the arithmetic and encode the bytes; the driver streams ordered chunks of bytes into the
    file and holds one at a time.
    """
    head = open_input(source)
    if os.path.realpath(destination) in {os.path.realpath(f) for f in [source, *head.files]}:
        raise TensorError("SourceDestinationConflict", destination)
    if os.path.exists(destination):
        raise TensorError("DestinationExists", destination)
    layout = plan.orderBy("ord").collect()
    if replan is not None and layout != replan.orderBy("ord").collect():
        raise TensorError("PlanMismatch", "the plan doesn't follow from the source and the decisions")
    spark, at = plan.sparkSession, 0
    for o in layout:
        if o.data_start != at or o.data_end - o.data_start != o.byte_len:
            raise TensorError("PlanOffsetMismatch", o.name)
        at = o.data_end
    actions = {r.tensor: r.action for r in decisions.collect()}
    rows = catalog(spark, source).orderBy("tensor").collect()
    header = {o.name: {"dtype": o.dtype, "shape": list(o.shape), "data_offsets": [o.data_start, o.data_end]} for o in layout}
    header["__metadata__"] = metadata(manifest(rows, actions, namespace), namespace)
    framed = frame(header)

    def parts() -> Iterator[bytes]:
        yield framed
        ordered = to_bytes(quantized, "qs", "i1").orderBy("tensor", "chunk").toLocalIterator()
        by_tensor = scales.orderBy("tensor").toLocalIterator()
        pending = next(ordered, None)
        for o in layout:
            if o.role == "preserved":
                file, begin = head.place(head.tensor(o.source_name))
                with open(file, "rb") as f:
                    f.seek(begin)
                    left = o.byte_len
                    while left:
                        raw = f.read(min(left, 1 << 20))
                        if not raw:
                            raise TensorError("DataLengthMismatch", o.name)
                        left -= len(raw)
                        yield raw
            elif o.role == "qdata":
                n = 0
                while pending is not None and pending.tensor == o.source_name:
                    raw = bytes(pending.bytes)
                    n, pending = n + len(raw), next(ordered, None)
                    yield raw
                if n != o.byte_len:
                    raise TensorError("DataLengthMismatch", o.name)
            else:
                s = next(by_tensor, None)
                if s is None or s.tensor != o.source_name:
                    raise TensorError("MissingScale", o.name)
                yield struct.pack("<f", s.scale)

    write_atomically(destination, parts(), len(framed) + at)


def write_tensors(path: str, tensors: list[tuple[str, str, list[int]]], data: DataFrame) -> None:
    """Write tensors (name, dtype, shape), laid out by name, from (tensor, chunk, bytes) in any order."""
    header, at = {}, 0
    for name, dtype, shape in sorted(tensors, key=lambda t: t[0].encode()):
        size = byte_length(dtype, shape)
        header[name] = {"dtype": dtype, "shape": list(shape), "data_offsets": [at, at + size]}
        at += size
    framed = frame(header)
    found = {r.tensor: r.n for r in data.groupBy("tensor").agg(F.sum(F.octet_length("bytes")).alias("n")).collect()}
    for name, spec in header.items():
        if found.pop(name, 0) != spec["data_offsets"][1] - spec["data_offsets"][0]:
            raise TensorError("DataLengthMismatch", name)
    if found:
        raise TensorError("TensorNotFound", min(found))

    def parts() -> Iterator[bytes]:
        yield framed
        for r in data.select("tensor", "chunk", "bytes").orderBy("tensor", "chunk").toLocalIterator():
            yield bytes(r.bytes)

    write_atomically(path, parts(), len(framed) + at)
