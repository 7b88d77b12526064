"""Quantizers and codecs: golden vectors, exhaustive codes, array against element rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom import catalog
from tensorloom.functions import numeric as n
from tensorloom.operators import arrays, diagnostics, policy, validate
from tensorloom.operators import quantize as q
from tensorloom.schema import TensorError
from tensorloom.sources import tables


def elements(spark, values, tensor="t"):
    return spark.createDataFrame([(tensor, i, float(v)) for i, v in enumerate(values)], "tensor string, idx bigint, v float")


def column(rows, name):
    return [r[name] for r in rows.orderBy("idx").collect()]


@pytest.mark.parametrize(("values", "scale", "want"), [([-1, -0.5, 0, 0.5, 1], 1 / 127, [-127, -64, 0, 64, 127]), ([-2, 0.5, 4], 4 / 127, [-64, 16, 127]), ([0, -0.0, 0], 1.0, [0, 0, 0])])
def test_int8_golden(spark, values, scale, want):
    rows = q.int8_quantize(elements(spark, values))
    assert column(rows, "q") == want
    assert np.float32(rows.first().scale) == np.float32(scale)


def test_int8_empty_and_tiny(spark):
    assert q.int8_quantize(elements(spark, [])).count() == 0
    tiny = q.int8_scales(elements(spark, [2.0**-149])).first().scale
    assert tiny == 2.0**-149


def test_int8_replay_equals_whole(spark):
    values = [(i - 512) / 31 for i in range(16_421)]
    rows = q.int8_replay(elements(spark, values), chunk=127).repartition(7)
    x = np.array(values, "<f4")
    s = np.float32(np.float32(np.abs(x).max()) / np.float32(127))
    y = (x / s).astype(np.float64)
    assert column(rows, "q") == np.clip(np.sign(y) * np.floor(np.abs(y) + 0.5), -127, 127).astype(int).tolist()
    assert rows.groupBy("chunk").count().filter("count <> 127").count() == 1
    with pytest.raises(TensorError, match="InvalidChunkSize"):
        q.int8_replay(elements(spark, [1]), chunk=0)


def test_int8_dequantize(spark):
    rows = spark.createDataFrame([(i, x, 0.25) for i, x in enumerate([-127, -1, 0, 1, 127])], "idx int, q int, scale float")
    assert column(q.dequantize(rows), "v_hat") == [-31.75, -0.25, 0, 0.25, 31.75]


def test_int4_golden(spark):
    rows = q.int4_quantize(elements(spark, [-1, 3, -2, 6, 0]), 2)
    assert column(rows, "q") == [-2, 7, -2, 7, 0]
    assert [np.float32(s) for s in column(rows, "scale")[::2]] == [np.float32(3 / 7), np.float32(6 / 7), 1]
    packed = q.pack_nibbles(rows)
    assert [r.byte for r in packed.orderBy("byte_idx").collect()] == [0x7E, 0x7E, 0x00]
    assert column(q.unpack_nibbles(packed, 5), "q") == [-2, 7, -2, 7, 0]
    with pytest.raises(TensorError, match="InvalidGroupSize"):
        q.int4_quantize(elements(spark, [1]), 0)


@pytest.mark.parametrize(("codes", "want"), [([-8, -7, -1, 0, 1, 7], "980f71"), ([-8, 7, -1, 1, 7], "781f07"), ([0, 1, 7, 15, 8], "10f708")])
def test_pack(spark, codes, want):
    rows = spark.createDataFrame([("t", i, c) for i, c in enumerate(codes)], "tensor string, idx bigint, q int")
    packed = q.pack_nibbles(rows)
    assert "".join(f"{r.byte:02x}" for r in packed.orderBy("byte_idx").collect()) == want
    signed = min(codes) < 0
    assert column(q.unpack_nibbles(packed, len(codes), signed), "q") == codes


def test_q8_0_golden(spark):
    rows = q.q8_0_quantize(elements(spark, [-1, -0.5, 0.5, 1, *[0] * 28]))
    assert column(rows, "q")[:5] == [-127, -64, 64, 127, 0]
    assert rows.first().scale == float(np.float16(1 / 127))
    assert {(r.q, r.scale) for r in q.q8_0_quantize(elements(spark, [0] * 32)).collect()} == {(0, 0.0)}
    for shape in ([], [31], [0, 32]):
        with pytest.raises(TensorError, match="InvalidShape"):
            q.q8_0_shape(shape)


def test_nvfp4_golden(spark):
    exact = [s * x for s in (-1, 1) for x in (6, 4, 3, 2, 1.5, 1, 0.5, 0)]
    rows = q.nvfp4_quantize(elements(spark, exact))
    assert rows.first().block_bits == 0x7E
    assert column(rows, "code")[:7] == [15, 14, 13, 12, 11, 10, 9] and column(rows, "code")[8:] == [7, 6, 5, 4, 3, 2, 1, 0]
    assert np.allclose(column(q.nvfp4_dequantize(rows), "v_hat"), exact)
    zeros = q.nvfp4_quantize(elements(spark, [0] * 17))
    assert {(r.block_bits, r.code, r.global_scale) for r in zeros.collect()} == {(0, 0, 1.0)}
    low = [0.0] * 32
    low[0], low[16] = 2.0**-149, 1.0
    assert q.nvfp4_quantize(elements(spark, low)).filter("grp = 0").first().block_bits == 1


@pytest.mark.parametrize(
    ("encode", "pairs"),
    [
        (n.e2m1_encode, [(0.25, 0), (0.75, 2), (1.75, 4), (5.0, 6), (7.0, 7), (-math.inf, 15), (-0.0, 8), (1.25 * 2.0**27, 7), (math.nan, None)]),
        (n.e4m3_encode, [(1.0625, 0x38), (500.0, 0x7E), (-math.inf, 0xFE), (math.nan, 0x7F), (-0.0, 0x80), (1.25 * 2.0**31, 0x7E), (2.0**-10, 0), (3 * 2.0**-11, 1)]),
        (n.e5m2_encode, [(1.125, 0x3C), (70000.0, 0x7B), (-math.inf, 0xFB), (math.nan, 0x7F), (-0.0, 0x80), (1.25 * 2.0**40, 0x7B)]),
    ],
)
def test_codec_edges(spark, encode, pairs):
    rows = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(pairs)], "idx int, v float")
    assert column(rows.withColumn("c", encode(F.col("v"))), "c") == [c for _, c in pairs]


@pytest.mark.parametrize(("encode", "decode", "size"), [(n.e2m1_encode, n.e2m1_decode, 16), (n.e4m3_encode, n.e4m3_decode, 256), (n.e5m2_encode, n.e5m2_decode, 256)])
def test_codec_nearest(spark, encode, decode, size):
    """Every code comes back; values between neighbours go to the nearer, ties to the even code."""
    rows = spark.range(size).select(F.col("id").alias("c"), decode(F.col("id")).alias("x")).collect()
    finite = {r.c: r.x for r in rows if math.isfinite(r.x)}
    up = sorted((x, c) for c, x in finite.items() if c < size // 2)
    cases = [(x, c) for c, x in finite.items()]
    for (a, ca), (b, cb) in zip(up, up[1:], strict=False):
        cases += [((a + b) / 2, ca if ca % 2 == 0 else cb), (a + (b - a) * 0.25, ca), (a + (b - a) * 0.75, cb)]
    frame = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "idx int, v float")
    assert column(frame.withColumn("c", encode(F.col("v"))), "c") == [c for _, c in cases]


def test_f16(spark):
    x = np.concatenate([np.random.default_rng(0).normal(0, 1, 500), 2.0 ** np.arange(-26, 17), [0, 65519, 65520, 1e-8]]).astype("<f4")
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "idx int, v float")
    with np.errstate(over="ignore"):
        want = x.astype("<f2")
    assert column(rows.withColumn("h", n.to_f16(F.col("v"))), "h") == want.astype(float).tolist()
    bits = rows.withColumn("b", n.f16_bits(n.to_f16(F.abs("v"))))
    assert column(bits, "b") == np.abs(want).view("<u2").tolist()


def test_arrays_equal_elements(spark):
    data = [(f"t{i}", [float(v) for v in np.random.default_rng(i).normal(0, 1 + i, 50).astype("<f4")]) for i in range(6)]
    frame = spark.createDataFrame(data, "tensor string, vals array<float>")
    rows = q.explode_arrays(frame, "tensor", "vals")
    by = lambda df: sorted((r.tensor, r.idx, r.q) for r in df.collect())
    flat = lambda df: df.select("tensor", F.posexplode("q").alias("idx", "q"))
    assert by(q.int8_quantize(rows)) == by(flat(arrays.int8(frame, "vals")))
    assert by(q.int4_quantize(rows, 12)) == by(flat(arrays.int4(frame, "vals", 12)))
    a = {r.tensor: r for r in arrays.metrics(arrays.int8(frame, "vals"), "vals").collect()}
    for r in diagnostics.tensor_diagnostics(q.dequantize(q.int8_quantize(rows)), 127).collect():
        o = a[r.tensor]
        assert (r.elements, r.saturated_values, r.max_abs_error) == (o.elements, o.saturated_values, o.max_abs_error)
        assert r.mse == pytest.approx(o.mse) and r.mae == pytest.approx(o.mae) and r.sqnr_db == pytest.approx(o.sqnr_db)


@pytest.mark.parametrize(("values", "at"), [([1.0, float("nan"), float("inf")], 1), ([0.0] * 5 + [float("-inf")], 5)])
def test_array_rows_finite(spark, values, at):
    df = spark.createDataFrame([([1.0, 2.0],), (values,)], "vals array<float>")
    for made in (arrays.int8(df, "vals").select("q"), arrays.int8(df, "vals").select("scale"), arrays.int4(df, "vals", 2).select("q")):
        with pytest.raises(Exception, match=f"NonFiniteInput: at index {at}"):
            made.collect()
    fine = spark.createDataFrame([([],), ([0.0, None],)], "vals array<float>")
    assert [r.scale for r in arrays.int8(fine, "vals").collect()] == [1.0, 1.0]


def test_metrics(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (2.0, 3.0), (3.0, 5.0)], "v float, v_hat float")
    r = rows.agg(*diagnostics.metric_columns()).first()
    assert (r.elements, r.mse, r.max_abs_error) == (3, 2.0, 2.0)
    assert r.mae == pytest.approx(4 / 3) and r.sqnr_db == pytest.approx(10 * math.log10(14 / 6))
    none = rows.limit(0).agg(*diagnostics.metric_columns()).first()
    assert (none.elements, none.mse, none.mae, none.max_abs_error, none.sqnr_db) == (0, 0.0, 0.0, 0.0, None)
    same = rows.select("v", F.col("v").alias("v_hat")).agg(*diagnostics.metric_columns()).first()
    assert (same.mse, same.sqnr_db) == (0.0, None)


def test_saturation_and_accounting(spark):
    rows = spark.createDataFrame([(x,) for x in (-127, -1, 0, 1, 127, 127)], "q int")
    assert rows.agg(diagnostics.saturation(127)).first()[0] == 3
    assert diagnostics.accounting(1024, 256, 4) == (260, 1024 / 260)
    assert diagnostics.accounting(0, 0, 0) == (0, None)
    golden = diagnostics.tensor_diagnostics(q.dequantize(q.int8_quantize(elements(spark, [-1, -0.5, 0, 0.5, 1]))), 127).first()
    assert (golden.quantized_bytes, golden.saturated_values, golden.compression_ratio) == (9, 2, 20 / 9)


def test_violations(spark):
    rows = elements(spark, [1, math.nan, math.inf, 2]).unionByName(elements(spark, [1, 2], "u"))
    with pytest.raises(TensorError, match="NonFiniteInput: tensor t at index 1"):
        validate.check(validate.non_finite(rows))
    validate.check(validate.non_finite(rows.filter("tensor = 'u'")))
    scales = spark.createDataFrame([("t", 0, 0.0), ("u", 0, 1.0)], "tensor string, grp bigint, scale float")
    assert [r.tensor for r in validate.bad_scales(scales).collect()] == ["t"]
    with pytest.raises(TensorError, match="LengthMismatch"):
        diagnostics.paired(rows, rows.filter("idx < 3").withColumn("v_hat", F.col("v")))


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_model_report_follows_policy(spark, sf_dir):
    """The report covers exactly the tensors that the policy quantizes."""
    names = [r.tensor for r in policy.decide(tables.catalog(spark, sf_dir)).filter("action = 'quantize'").collect()]
    assert "embeddings.embedding" in names
    worst, saturated = 0.0, 0
    for name in names:
        t, c = name.split(".")
        v = np.array([x for (x,) in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(c).toLocalIterator()], np.float32).ravel()
        scale = np.abs(v).max() / np.float32(127)
        y = (v / scale).astype(float)
        code = np.clip(np.sign(y) * np.floor(np.abs(y) + 0.5), -127, 127).astype(np.float32)
        worst, saturated = max(worst, float(np.abs(v.astype(float) - (code * scale).astype(float)).max())), saturated + int((np.abs(code) == 127).sum())
    got = catalog.model_report(spark, sf_dir).first()
    assert (got.quantized_tensors, got.saturated_values) == (len(names), saturated)
    assert np.isclose(got.max_abs_error, worst)
