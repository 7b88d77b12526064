"""SafeTensors, GGUF, policy, layout, command line and streams."""

import json
import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tensorloom import catalog as queries
from tensorloom import cli
from tensorloom.operators import layout, policy
from tensorloom.plans import model
from tensorloom.schema import TensorError, byte_length, element_count
from tensorloom.sources import gguf
from tensorloom.sources import safetensors as st
from tensorloom.streaming import replay


def put(path, tensors, notes=None):
    header, at = ({"__metadata__": notes} if notes else {}), 0
    for name, (dtype, shape, raw) in tensors.items():
        header[name] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + len(raw)]}
        at += len(raw)
    path.write_bytes(st.frame(header) + b"".join(r for *_, r in tensors.values()))
    return str(path)


def raw_header(path, header, data=b""):
    raw = header if isinstance(header, bytes) else json.dumps(header).encode()
    path.write_bytes(struct.pack("<Q", len(raw)) + raw + data)
    return str(path)


THREE = {"bias": ("F32", [2], struct.pack("<2f", 1.25, -2)), "weight": ("F16", [2, 2], np.array([-2, 0.5, 1, 0], "<f2").tobytes()), "bf16": ("BF16", [2], b"\x80\x3f\x00\xc0")}


def test_three_types(spark, tmp_path):
    path = put(tmp_path / "a", THREE, {"format": "test"})
    assert [t.name for t in st.read_header(path).tensors] == ["bias", "weight", "bf16"]
    got = {r.tensor: r.vals for r in st.chunks(spark, path).collect()}
    assert got == {"bias": [1.25, -2], "weight": [-2, 0.5, 1, 0], "bf16": [1, -2]}
    assert [r.vals for r in st.chunks(spark, path, tensor="weight").collect()] == [[-2, 0.5, 1, 0]]
    assert [r.vals for r in st.chunks(spark, path).filter("tensor = 'bias'").collect()] == [[1.25, -2]]
    assert [bytes(r.bytes) for r in st.payload(spark, path, "bf16").collect()] == [b"\x80\x3f\x00\xc0"]
    assert "  weight | dtype=F16 | shape=[2, 2] | bytes=8" in model.inspect(path)
    with pytest.raises(TensorError, match="TensorNotFound"):
        st.chunks(spark, path, tensor="none")


def test_chunk_frames(spark, tmp_path):
    path = put(tmp_path / "a", {"x": ("F32", [10], np.arange(10, dtype="<f4").tobytes())})
    rows = st.chunks(spark, path, chunk=4).orderBy("chunk").collect()
    assert [(r.base_idx, r.vals) for r in rows] == [(0, [0, 1, 2, 3]), (4, [4, 5, 6, 7]), (8, [8, 9])]


@pytest.mark.parametrize(
    ("header", "data", "code"),
    [
        (b"\xff\xfe", b"", "InvalidHeaderUtf8"),
        (b"{", b"", "InvalidHeaderJson"),
        (b"[]", b"", "InvalidHeaderJson"),
        ({"__metadata__": {"a": 1}}, b"", "InvalidMetadata"),
        ({"x": {"dtype": "F99", "shape": [1], "data_offsets": [0, 4]}}, b"0000", "InvalidMetadata"),
        ({"x": {"dtype": "F32", "shape": [1.5], "data_offsets": [0, 4]}}, b"0000", "InvalidMetadata"),
        ({"x": {"dtype": "F32", "shape": [1], "data_offsets": [0, 5]}}, b"00000", "InvalidMetadata"),
        ({"x": {"dtype": "F32", "shape": [1], "data_offsets": [4, 8]}}, b"00000000", "InvalidMetadata"),
        ({"x": {"dtype": "F32", "shape": [1], "data_offsets": [0, 4]}}, b"0000000", "MetadataIncompleteBuffer"),
    ],
)
def test_bad_headers(tmp_path, header, data, code):
    with pytest.raises(TensorError) as e:
        st.read_header(raw_header(tmp_path / "a", header, data))
    assert e.value.code == code


def test_short_files(tmp_path):
    for raw, code in ((b"bad", "HeaderTooSmall"), (struct.pack("<Q", 1 << 40), "HeaderTooLarge"), (struct.pack("<Q", 99) + b"{}", "MetadataIncompleteBuffer")):
        (tmp_path / "b").write_bytes(raw)
        with pytest.raises(TensorError) as e:
            st.read_header(str(tmp_path / "b"))
        assert e.value.code == code


def test_shapes():
    assert element_count([]) == 1 and element_count([1 << 63, 2, 0]) == 0
    assert byte_length("F4", [2]) == 1
    for call in (lambda: element_count([1 << 63, 2]), lambda: byte_length("F4", [3])):
        with pytest.raises(TensorError):
            call()


def test_policy(spark):
    rows = spark.createDataFrame([("labels", 10_000, "non-floating"), ("bias", 3, "floating"), ("weight", 4, "floating"), ("none", 0, "floating")], "tensor string, element_count bigint, kind string")
    got = {r.tensor: (r.action, r.reason_text) for r in policy.decide(rows, 4).collect()}
    assert got["labels"] == ("preserve", "non-floating tensors are preserved")
    assert got["bias"] == ("preserve", "floating tensor has 3 elements, below minimum 4")
    assert got["weight"] == ("quantize", "floating tensor has 4 elements, meeting minimum 4")
    assert {r.action for r in policy.decide(rows.filter("tensor = 'none'"), 0).collect()} == {"preserve"}


def sources(spark, rows):
    return spark.createDataFrame([(n, d, s, b, element_count(s)) for n, d, s, b in rows], "tensor string, dtype string, shape array<bigint>, byte_len bigint, element_count bigint")


def test_layout(spark):
    s = sources(spark, [("weight", "F32", [4], 16), ("ids", "U8", [3], 3), ("bias", "F32", [2], 8)])
    d = policy.decide(s, 4)
    want = [("bias", 0, 8), ("ids", 8, 11), ("weight.qdata", 11, 15), ("weight.scale", 15, 19)]
    for frame in (s, s.orderBy(F.desc("tensor"))):
        assert [(r.name, r.data_start, r.data_end) for r in layout.plan(frame, d).orderBy("ord").collect()] == want


def test_layout_rules(spark):
    s = sources(spark, [("weight", "F32", [4], 16), ("weight.qdata", "U8", [1], 1)])
    d = policy.decide(s, 4)
    with pytest.raises(TensorError, match="OutputNameCollision"):
        layout.plan(s, d)
    codes = lambda a, b: {r.code for r in layout.violations(a, b).collect()}
    assert "DuplicateSourceName" in codes(s.unionByName(s), d)
    assert codes(s.limit(1), d.filter("false")) == {"MissingDecision"}
    forced = s.filter("dtype = 'U8'").withColumns({"kind": F.lit("non-floating"), "action": F.lit("quantize")})
    assert codes(s.filter("dtype = 'U8'"), forced) == {"QuantizationRequiresFloating", "UnsupportedQuantizedDtype"}
    assert "ReservedTensorName" in codes(sources(spark, [("__metadata__", "U8", [1], 1)]), d)


def test_quantize_file(spark, tmp_path):
    v = ((np.arange(16507) - 1024) / 64).astype("<f4")
    path = put(tmp_path / "in", {"ids": ("U8", [3], b"\1\2\3"), "weight": ("F32", [16507], v.tobytes())})
    outs = [str(tmp_path / f"out{i}") for i in range(2)]
    for o in outs:
        lines = model.quantize(spark, path, o)
    assert open(outs[0], "rb").read() == open(outs[1], "rb").read()
    assert "  Tensors: 1 quantized, 1 preserved" in lines and lines[0] == "Progress: 1/2 | ids | preserve (non-floating tensors are preserved)"
    h = st.read_header(outs[0])
    raw = open(outs[0], "rb").read()
    part = lambda n: raw[h.data_start + h.tensor(n).start : h.data_start + h.tensor(n).end]
    s = np.float32(np.abs(v).max()) / np.float32(127)
    y = (v / s).astype(float)
    assert part("ids") == b"\1\2\3" and part("weight.scale") == s.astype("<f4").tobytes()
    assert part("weight.qdata") == np.clip(np.sign(y) * np.floor(np.abs(y) + 0.5), -127, 127).astype(np.int8).tobytes()
    with pytest.raises(TensorError, match="DestinationExists"):
        model.quantize(spark, path, outs[0])
    with pytest.raises(TensorError, match="SourceDestinationConflict"):
        p = model.plan(spark, path)
        st.write(path, path, p.layout, p.decisions, p.quantized, p.scales)


def test_small_file_and_failure(spark, tmp_path):
    path = put(tmp_path / "in", {"ids": ("U8", [3], b"\7\10\11"), "weight": ("F32", [2], struct.pack("<2f", 1, -0.5))})
    model.quantize(spark, path, str(tmp_path / "out"), minimum=2)
    raw = (tmp_path / "out").read_bytes()
    assert raw.endswith(b"\7\10\11\x7f\xc0" + np.float32(1 / 127).astype("<f4").tobytes())
    bad = put(tmp_path / "nan", {"weight": ("F32", [2], struct.pack("<2f", float("nan"), 1))})
    with pytest.raises(TensorError, match="NonFiniteInput: tensor weight at index 0"):
        model.quantize(spark, bad, str(tmp_path / "none"), minimum=2)
    assert not (tmp_path / "none").exists() and not [p for p in tmp_path.iterdir() if p.suffix == ".tmp"]


def sharded(folder, files, index=None):
    """Shards of THREE and their index in a folder of its own."""
    folder.mkdir()
    for name, tensors in files.items():
        put(folder / name, {t: THREE[t] for t in tensors})
    own = {"weight_map": {t: name for name, tensors in files.items() for t in tensors}} if index is None else index
    (folder / "m.safetensors.index.json").write_text(own if isinstance(own, str) else json.dumps(own))
    return folder


TWO = {"b.safetensors": ["bf16", "weight"], "a.safetensors": ["bias"]}
MAP = {"bf16": "b.safetensors", "weight": "b.safetensors", "bias": "a.safetensors"}


def test_shards(spark, tmp_path):
    folder = sharded(tmp_path / "s", TWO, {"weight_map": MAP, "metadata": {"total_size": 20, "x": [1]}, "other": 1})
    one = put(tmp_path / "one", THREE)
    for path in (str(folder), str(folder / "m.safetensors.index.json")):
        h = st.open_input(path)
        assert [t.name for t in h.tensors] == ["bf16", "bias", "weight"] and len(h.files) == 2
        rows = lambda p: sorted((r.tensor, r.chunk, r.vals) for r in st.chunks(spark, p, 1).collect())  # noqa: B023, E731
        assert rows(path) == rows(one)
        assert {r.tensor: r.path.rsplit("/", 1)[1] for r in st.catalog(spark, path).collect()} == MAP
        assert st.payload(spark, path, "bias").first().bytes == THREE["bias"][2]
    assert "Shards: 2" in model.inspect(str(folder))
    model.quantize(spark, one, str(tmp_path / "q1"), minimum=3)
    lines = model.quantize(spark, str(folder), str(tmp_path / "q2"), minimum=3)
    assert (tmp_path / "q1").read_bytes() == (tmp_path / "q2").read_bytes()
    assert f"  Source bytes: {sum(f.stat().st_size for f in folder.glob('*.safetensors'))}" in lines
    assert model.validated(spark, str(folder), str(tmp_path / "q2"), 3)
    p = model.plan(spark, str(folder))
    with pytest.raises(TensorError, match="SourceDestinationConflict"):
        st.write(str(folder), str(folder / "a.safetensors"), p.layout, p.decisions, p.quantized, p.scales)


@pytest.mark.parametrize(
    ("files", "index", "code"),
    [
        (TWO, "{", "InvalidIndex"),
        (TWO, [], "InvalidIndex"),
        (TWO, {"weight_map": []}, "InvalidIndex"),
        (TWO, {"weight_map": MAP | {"bias": ""}}, "InvalidIndex"),
        (TWO, {"weight_map": MAP | {"__metadata__": "a.safetensors"}}, "InvalidIndex"),
        (TWO, {"weight_map": MAP, "metadata": 1}, "InvalidIndex"),
        (TWO, {"weight_map": MAP, "metadata": {"total_size": -1}}, "InvalidIndex"),
        (TWO, {"weight_map": MAP, "metadata": {"total_size": 21}}, "TotalSizeMismatch"),
        (TWO, '{"weight_map": {"bias": "a.safetensors", "bias": "b.safetensors"}}', "DuplicateTensor"),
        (TWO | {"c.safetensors": ["bias"]}, {"weight_map": MAP | {"bf16": "c.safetensors"}}, "DuplicateTensor"),
        (TWO, {"weight_map": MAP | {"more": "a.safetensors"}}, "ShardTensorMismatch"),
        (TWO, {"weight_map": {"bf16": "b.safetensors", "bias": "a.safetensors"}}, "ShardTensorMismatch"),
        (TWO, {"weight_map": MAP | {"bias": "b.safetensors", "weight": "a.safetensors"}}, "ShardTensorMismatch"),
        (TWO, {"weight_map": MAP | {"bias": "none.safetensors"}}, "MissingShard"),
        (TWO, {"weight_map": MAP | {"bias": "m.safetensors.index.json"}}, "InvalidShard"),
        *[(TWO, {"weight_map": MAP | {"bias": bad}}, "UnsafeShard") for bad in ("../a.safetensors", "/a", "x\\a", "C:a", "..", "a\0")],
    ],
)
def test_bad_shards(tmp_path, files, index, code):
    folder = sharded(tmp_path / "s", files, index)
    with pytest.raises(TensorError) as e:
        st.open_input(str(folder))
    assert e.value.code == code


def test_discovery(tmp_path):
    folder = sharded(tmp_path / "s", TWO)
    (folder / "n.safetensors.index.json").write_text("{}")
    (tmp_path / "empty").mkdir()
    for path in (folder, tmp_path / "empty"):
        with pytest.raises(TensorError, match="AmbiguousInput"):
            st.open_input(str(path))
    assert len(st.open_input(str(folder / "m.safetensors.index.json")).tensors) == 3
    (folder / "n.safetensors.index.json").unlink()
    (folder / "m.safetensors.index.json").unlink()
    with pytest.raises(TensorError, match="AmbiguousInput"):
        st.open_input(str(folder))
    (folder / "a.safetensors").unlink()
    assert st.open_input(str(folder)).path.endswith("b.safetensors")


def test_output_is_read(spark, tmp_path):
    """The report comes from the output's own qdata and scale, so a file that was written wrong shows."""
    v = ((np.arange(16507) - 1024) / 64).astype("<f4")
    path, out = put(tmp_path / "in", {"half": ("F16", [2048], (np.arange(2048) / 7).astype("<f2").tobytes()), "weight": ("F32", [16507], v.tobytes())}), str(tmp_path / "out")
    model.quantize(spark, path, out)
    p, h, good = model.plan(spark, path), st.read_header(out), (tmp_path / "out").read_bytes()
    at = lambda name: slice(h.data_start + h.tensor(name).start, h.data_start + h.tensor(name).end)
    q, scale = np.frombuffer(good[at("weight.qdata")], np.int8), np.frombuffer(good[at("weight.scale")], "<f4")[0]
    first = model.check_output(spark, p, out)

    def checked(codes, factor):
        raw = bytearray(good)
        raw[at("weight.qdata")], raw[at("weight.scale")] = codes.tobytes(), np.float32(scale * factor).astype("<f4").tobytes()
        (tmp_path / "out").write_bytes(raw)
        r = model.check_output(spark, p, out)
        e = v.astype(float) - (codes.astype("f4") * np.float32(scale * factor)).astype(float)
        assert np.isclose(r["max_abs_error"], max(np.abs(e).max(), first["max_abs_error"])) and np.isclose(r["max_mse"], max((e * e).mean(), first["max_mse"]))
        return r

    assert checked(q, 1) == first
    assert checked(np.roll(q, 7)[::-1].copy(), 1)["max_mse"] > 10 * first["max_mse"]
    assert checked(q, 3)["max_mae"] > 10 * first["max_mae"]
    assert checked(np.full_like(q, 127), 1)["saturated_values"] >= len(q)
    beyond = q.copy()
    beyond[16400] = -128
    with pytest.raises(TensorError, match="QuantizedValueOutOfRange: tensor weight at index 16400"):
        checked(beyond, 1)
    with pytest.raises(TensorError, match="DequantizedValueOverflow: tensor weight"):
        checked(q, np.float64(3e38) / scale)


def test_command_line(spark, tmp_path, capsys):
    path = put(tmp_path / "a", THREE)
    assert cli.main(["inspect", path]) == 0
    assert capsys.readouterr().out.startswith("Format: SafeTensors\nFile size: ")
    for option in (["--format", "int4"], ["--device", "gpu"]):
        assert cli.main(["quantize", path, str(tmp_path / "b"), *option]) == 1
    assert "error: " in capsys.readouterr().err


def test_gguf(tmp_path):
    v = ((np.arange(64) - 31.5) / 10).astype("<f4")
    raw = gguf.encode("weight", [2, 32], v)
    h, blocks = gguf.read(raw)
    t = h.tensors[0]
    assert (h.version, len(h.metadata), t.shape, t.byte_len, t.offset, h.data_offset, len(raw)) == (3, 3, (2, 32), 68, 0, 192, 288)
    assert np.allclose(gguf.dequantize_blocks(blocks), v, atol=0.03) and raw == gguf.encode("weight", [2, 32], v)
    gguf.write(str(tmp_path / "g"), "weight", [2, 32], v)
    with pytest.raises(TensorError, match="DestinationExists"):
        gguf.write(str(tmp_path / "g"), "weight", [2, 32], v)
    for broken, code in ((b"GGUX" + raw[4:], "Malformed"), (raw[:4] + b"\2" + raw[5:], "UnsupportedVersion"), (raw[:-40], "Malformed"), (raw[:30], "Malformed")):
        with pytest.raises(TensorError, match=code):
            gguf.read(broken)
    with pytest.raises(TensorError, match="InvalidShape"):
        gguf.encode("weight", [2, 31], v[:62])
    block = gguf.quantize_blocks(np.array([-1, -0.5, 0.5, 1, *[0] * 28], "<f4"))
    assert block[:2] == np.float16(1 / 127).tobytes() and np.frombuffer(block[2:7], np.int8).tolist() == [-127, -64, 64, 127, 0]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("t", 0, [1.0, -2.0]), ("t", 1, [4.0])], "tensor string, chunk bigint, vals array<float>")
    rows.write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "s"))
    got = []
    job = replay.whole_tensors(stream, lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    job.processAllAvailable()
    job.stop()
    assert sorted((r.chunk, list(r.qs)) for r in got) == [(0, [32, -64]), (1, [127])]
    scales = spark.createDataFrame([("t", 1.0)], "tensor string, scale float")
    assert sorted(r.qs for r in replay.with_scales(rows, scales).collect()) == [[1, -2], [4]]
    bad = spark.createDataFrame([("t", 0, [1.0]), ("t", 1, [float("nan")])], rows.schema)
    with pytest.raises(Exception, match="NonFiniteInput: tensor t in chunk 1"):
        replay.with_scales(bad, scales).collect()
    bad.write.parquet(str(tmp_path / "b"))
    job = replay.whole_tensors(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "b")), lambda df, _: df.collect()).option("checkpointLocation", str(tmp_path / "d")).start()
    with pytest.raises(Exception, match="NonFiniteInput: tensor t in chunk 1"):
        job.processAllAvailable()
    job.stop()


def test_catalog_has_sql():
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert set(queries.QUERIES) == set(queries.ORACLES)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_duckdb(spark, small, name):
    import os

    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        p = f"{small}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    out = queries.QUERIES[name](spark, small)
    names = sorted(out.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(tuple(r[n] for n in names) for r in out.collect()) == sorted(want)


class Handed:
    """Stands for rows: keeps the function that they are mapped with."""

    def select(self, *columns):
        return self

    def mapInArrow(self, f, schema):  # noqa: N802
        return f


@pytest.mark.parametrize(("kind", "storage"), [("float32", "<f4"), ("int8", "i1"), ("int32", "<i4"), ("int32", "u1")])
def test_encoding_holds_a_piece(spark, kind, storage):
    """Encoding a batch of 64 MB takes memory for a piece of it, not for copies of the batch."""
    size = np.random.default_rng(5).integers(0, 2 * 16384, 1024 * 4 // np.dtype(kind).itemsize)
    size[[0, 7, 8, -1]] = 0
    ends = np.concatenate([[0], np.cumsum(size)]).astype("<i4")
    v = (np.arange(ends[-1]) % 251 if storage != "i1" else np.arange(ends[-1]) % 255 - 127).astype(kind)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(v))
    rows = pa.RecordBatch.from_arrays([pa.array(["x"] * len(size)), pa.array(np.arange(len(size))), lists], ["tensor", "chunk", "vals"])
    whole, encode, at, least = v.astype(storage), st.to_bytes(Handed(), "vals", storage), 0, pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        most = 0
        for b in encode(iter([rows.slice(3)])):
            most = max(most, pa.total_allocated_bytes() - least)
            for n, x in zip(b.column(1).to_numpy(), b.column(2), strict=True):
                assert n == at + 3 and x.as_buffer().equals(pa.py_buffer(whole[ends[n] : ends[n + 1]]))
                at += 1
            assert b.column(2).nbytes <= 5 << 20
        most = max(most, tracemalloc.get_traced_memory()[1])
    finally:
        tracemalloc.stop()
    assert at == len(size) - 3 and most < 12 << 20


def test_integers_need_one_worker(spark, tmp_path):
    """Codes and integers come from the source itself, a chunk at a time; no second Python worker gets them in batches."""
    i8, i64 = (np.arange(40_000) % 255 - 127).astype("i1"), np.arange(20_000) * -(1 << 40)
    path = put(tmp_path / "a", {"a": ("I8", [40_000], i8.tobytes()), "b": ("I64", [20_000], i64.astype("<i8").tobytes()), "c": ("I16", [2], struct.pack("<2h", -2, 3))})
    codes, whole = st.codes(spark, path, ["a"]), st.integers(spark, path, ["a", "b", "c"])
    for rows in (codes, whole):
        assert "MapInArrow" not in rows._jdf.queryExecution().toString()
    assert codes.dtypes == [("tensor", "string"), ("chunk", "bigint"), ("qs", "array<tinyint>")]
    assert [r.chunk for r in codes.orderBy("chunk").collect()] == [0, 1, 2]
    assert np.array_equal(np.concatenate([r.qs for r in codes.orderBy("chunk").collect()]), i8)
    got = {t: np.concatenate([r.vals for r in whole.filter(F.col("tensor") == t).orderBy("chunk").collect()]).tolist() for t in "abc"}
    assert got == {"a": i8.tolist(), "b": i64.tolist(), "c": [-2, 3]}
    assert whole.filter("tensor = 'b'").count() == 3
    with pytest.raises(TensorError, match="UnsupportedTensorDtype"):
        st.codes(spark, path, ["b"])
