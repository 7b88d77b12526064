"""Blocks and parts against element rows, and the rules that values and parts must keep."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.operators import blocks, parts, validate
from tensorloom.operators import quantize as q
from tensorloom.schema import TensorError


def chunked(spark, values, step, tensor="t"):
    rows = [(tensor, i, [float(x) for x in values[i : i + step]]) for i in range(0, len(values), step)]
    return spark.createDataFrame(rows, "tensor string, base_idx bigint, vals array<float>")


def flat(spark, values, tensor="t"):
    return spark.createDataFrame([(tensor, i, float(v)) for i, v in enumerate(values)], "tensor string, idx bigint, v float")


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


VALUES = np.random.default_rng(5).normal(0, 3, 320).astype("<f4")


@pytest.fixture(scope="module")
def both(spark):
    return chunked(spark, VALUES, 64).repartition(3), flat(spark, VALUES).repartition(5)


@pytest.mark.parametrize("size", [16, 32, 64])
def test_int4_blocks(both, size):
    names = ("tensor", "idx", "grp", "scale", "q")
    assert rows(blocks.int4_elements(both[0], size), *names) == rows(q.int4_quantize(both[1], size), *names)


@pytest.mark.parametrize(("workers", "size"), [(1, 1), (3, 50), (None, 320), (7, 10_000)])
def test_parallel(both, workers, size):
    """Workers and chunks change nothing in the result; groups stay whole."""
    own = blocks.Parallel(workers, size)
    each = lambda df: rows(df.select((F.col("base_idx")).alias("at"), "scale", F.posexplode("q").alias("i", "q")).select((F.col("at") + F.col("i")).alias("idx"), "scale", "q"), "idx", "scale", "q")
    assert each(blocks.int8(both[0], own)) == each(blocks.int8(both[0]))
    assert rows(blocks.int4_elements(both[0], 31, parallel=own), "idx", "scale", "q") == rows(q.int4_quantize(both[1], 31), "idx", "scale", "q")
    if workers:
        assert own.spread(both[0]).rdd.getNumPartitions() == workers


@pytest.mark.parametrize("own", [blocks.Parallel(0, 1), blocks.Parallel(-1), blocks.Parallel(1, 0)])
def test_parallel_rules(spark, both, own):
    with pytest.raises(TensorError, match="InvalidConfig"):
        blocks.int8(both[0], own)
    with pytest.raises(TensorError, match="InvalidConfig"):
        blocks.int4(both[0], 32, parallel=own)
    with pytest.raises(TensorError, match="InvalidGroupSize"):
        blocks.int4(both[0], 0, parallel=blocks.Parallel())
    bad = chunked(spark, [1.0, float("nan")], 1)
    with pytest.raises(TensorError, match="NonFiniteInput: tensor t at index 1"):
        blocks.int8(bad, blocks.Parallel(2, 1))


@pytest.mark.parametrize("size", [31, 7, 100, 1000])
def test_rechunk(spark, both, size):
    """Groups that chunks cut apart are whole again, whatever the chunks were."""
    whole = blocks.rechunk(both[0], size)
    assert rows(whole.select("base_idx", F.size("vals").alias("n")), "base_idx", "n") == [(i, min(size, 320 - i)) for i in range(0, 320, size)]
    assert rows(blocks.int4_elements(whole, size), "idx", "scale", "q") == rows(q.int4_quantize(both[1], size), "idx", "scale", "q")
    assert rows(blocks.of_elements(both[1], size), "base_idx", "vals") == rows(whole, "base_idx", "vals")


def test_other_formats(both):
    for own, other, names in [
        (blocks.q8_0_elements, q.q8_0_quantize, ("idx", "grp", "scale", "q")),
        (blocks.nvfp4_elements, q.nvfp4_quantize, ("idx", "grp", "block_bits", "scale", "global_scale", "code")),
    ]:
        assert rows(own(both[0]), *names) == rows(other(both[1]), *names)
    own = blocks.int8(both[0]).select("base_idx", "scale", F.posexplode("q").alias("i", "q")).select((F.col("base_idx") + F.col("i")).alias("idx"), "scale", "q")
    assert rows(own, "idx", "scale", "q") == rows(q.int8_quantize(both[1]), "idx", "scale", "q")
    own = blocks.per_channel_int8(both[0], 64).select("start", F.posexplode("q").alias("i", "q")).select((F.col("start") + F.col("i")).alias("idx"), "q")
    assert rows(own, "idx", "q") == rows(q.per_channel_int8(both[1], 64), "idx", "q")


def test_no_element_shuffle(both):
    """Rows of elements are never exchanged, nor are chunks."""
    for made in (blocks.int4_elements(both[0], 32), blocks.q8_0_elements(both[0]), blocks.nvfp4_elements(both[0])):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Aggregate" not in plan


QUANTIZERS = {
    "int8": q.int8_quantize, "int8_scales": q.int8_scales, "int4": lambda d: q.int4_quantize(d, 32), "q8_0": q.q8_0_quantize, "nvfp4": q.nvfp4_quantize, "channel": lambda d: q.per_channel_int8(d, 64),
}
BLOCKS = {"int8": blocks.int8, "int4": lambda d: blocks.int4(d, 32), "q8_0": blocks.q8_0, "nvfp4": blocks.nvfp4, "channel": lambda d: blocks.per_channel_int8(d, 64)}
PARTS = {"int8": lambda d: parts.int8(d, "x"), "int4": lambda d: parts.int4(d, "x", 7), "q8_0": lambda d: parts.q8_0(d, "x"), "nvfp4": lambda d: parts.nvfp4(d, "x")}


@pytest.mark.parametrize("bad", [math.nan, math.inf, -math.inf])
def test_non_finite(spark, bad):
    """Every quantizer names the lowest index of the first tensor that has a value that isn't finite."""
    values = VALUES.copy()
    values[[70, 200]] = bad
    fine, odd = flat(spark, VALUES, "a"), flat(spark, values, "b")
    for name, f in QUANTIZERS.items():
        with pytest.raises(TensorError, match="NonFiniteInput: tensor b at index 70"):
            f(fine.unionByName(odd))
        assert f(fine).count(), name
    for f in BLOCKS.values():
        with pytest.raises(TensorError, match="NonFiniteInput: tensor b at index 70"):
            f(chunked(spark, VALUES, 64, "a").unionByName(chunked(spark, values, 64, "b")))
    table = spark.createDataFrame([("a", VALUES.tolist()), ("b", values.tolist())], "tensor string, x array<double>")
    for f in PARTS.values():
        with pytest.raises(TensorError, match="NonFiniteInput: tensor b at index 70"):
            f(table)


def test_many_tensors(spark, monkeypatch):
    """More tensors than the driver holds: the maxima stay a relation, the rule holds."""
    monkeypatch.setattr(validate, "MOST_TOPS", 2)
    frame = spark.createDataFrame([(f"t{i}", k, float(i + k)) for i in range(5) for k in range(32)], "tensor string, idx bigint, v float")
    assert q.int8_quantize(frame).filter("q = 127").count() == 5
    with pytest.raises(TensorError, match="NonFiniteInput: tensor t3 at index 4"):
        q.int8_quantize(frame.withColumn("v", F.when((F.col("tensor") == "t3") & (F.col("idx") > 3), float("nan")).otherwise(F.col("v")).cast("float")))


def test_q8_0_rules(spark):
    with pytest.raises(TensorError, match="InvalidLength"):
        q.q8_0_quantize(flat(spark, [1] * 33))
    with pytest.raises(TensorError, match="InvalidScale"):
        q.q8_0_quantize(flat(spark, [1e7] * 32))
    for shape in ([32], [2, 32], [3, 1, 64]):
        assert q.q8_0_shape(shape, math.prod(shape)) == math.prod(shape)
    for shape in ([], [31], [0, 32], [32, 0]):
        with pytest.raises(TensorError, match="InvalidShape"):
            q.q8_0_shape(shape)
    with pytest.raises(TensorError, match="ShapeElementCountOverflow"):
        q.q8_0_shape([1 << 40, 1 << 40, 32])


def test_nvfp4_shape():
    assert q.nvfp4_shape([2, 48], 96) == 96
    for shape in ([], [0, 16], [16, 0], [17]):
        with pytest.raises(TensorError, match="InvalidShape"):
            q.nvfp4_shape(shape)
    with pytest.raises(TensorError, match="ShapeLengthMismatch"):
        q.nvfp4_shape([2, 16], 31)
    with pytest.raises(TensorError, match="ShapeElementCountOverflow"):
        q.nvfp4_shape([1 << 40, 1 << 40, 16])


def test_given_scales(spark):
    scales = lambda s: spark.createDataFrame([("t", s)], "tensor string, scale float")
    with pytest.raises(TensorError, match="InvalidScale"):
        q.int8_quantize(flat(spark, [1]), scales(0.0))
    with pytest.raises(TensorError, match="QuantizedValueOverflow: tensor t at index 1"):
        q.int8_quantize(flat(spark, [1e-44, 3e38]), scales(2.0**-149))
    assert [r.q for r in q.int8_quantize(flat(spark, [1]), scales(0.5)).collect()] == [2]


def test_nibble_rules(spark):
    codes = spark.createDataFrame([("t", i, c) for i, c in enumerate([0, 7, 8])], "tensor string, idx bigint, q int")
    with pytest.raises(TensorError, match="PackedValueOutOfRange: tensor t at index 2"):
        q.pack_nibbles(codes, signed=True)
    with pytest.raises(TensorError, match="PackedLengthMismatch"):
        q.unpack_nibbles(q.pack_nibbles(codes), 5)
    nan = flat(spark, [1, math.nan])
    with pytest.raises(TensorError, match="NaNNotRepresentable: tensor t at index 1"):
        validate.check(validate.unrepresentable(nan))


DATA = [("odd", VALUES[:33].tolist()), ("even", VALUES[:64].tolist()), ("zero", [0.0] * 32), ("empty", [])]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(DATA, "tensor string, x array<double>")


def test_parts_equal_elements(spark, table):
    long = q.explode_arrays(table, "tensor", "x")
    got = {r.tensor: r for r in parts.int4(table, "x", 7).collect()}
    for r in q.pack_nibbles(q.int4_quantize(long, 7)).collect():
        assert got[r.tensor].packed[r.byte_idx] == r.byte
    assert {t: (len(r.packed), len(r.scales), r.elements) for t, r in got.items()} == {"odd": (17, 5, 33), "even": (32, 10, 64), "zero": (16, 5, 32), "empty": (0, 0, 0)}
    want = {(r.tensor, r.idx): r.v_hat for r in q.dequantize(q.int4_quantize(long, 7)).collect()}
    assert {(r.tensor, i): v for r in parts.dequantize_int4(parts.int4(table, "x", 7)).collect() for i, v in enumerate(r.v_hat)} == want
    want = {(r.tensor, r.idx): r.v_hat for r in q.nvfp4_dequantize(q.nvfp4_quantize(long)).collect()}
    assert {(r.tensor, i): v for r in parts.dequantize_nvfp4(parts.nvfp4(table, "x")).collect() for i, v in enumerate(r.v_hat)} == want
    even = table.filter("tensor in ('even', 'zero')")
    want = {(r.tensor, r.idx): r.v_hat for r in q.dequantize(q.q8_0_quantize(q.explode_arrays(even, "tensor", "x"))).collect()}
    assert {(r.tensor, i): v for r in parts.dequantize_q8_0(parts.q8_0(even, "x")).collect() for i, v in enumerate(r.v_hat)} == want
    with pytest.raises(TensorError, match="InvalidLength"):
        parts.q8_0(table.filter("tensor = 'odd'"), "x")


def broken(df, **columns):
    for name, text in columns.items():
        df = df.withColumn(name, F.expr(text))
    return df


@pytest.mark.parametrize(
    ("columns", "want"),
    [
        ({"group_size": "0"}, ("InvalidGroupSize", 0)),
        ({"packed": "slice(packed, 1, 16)"}, ("PackedLengthMismatch", 17)),
        ({"scales": "array_append(scales, 1f)"}, ("ScaleCountMismatch", 5)),
        ({"scales": "transform(scales, (s, i) -> if(i in (2, 3), cast(-1 as float), s))"}, ("InvalidScale", 2)),
        ({"scales": "transform(scales, (s, i) -> if(i = 4, cast('nan' as float), s))"}, ("InvalidScale", 4)),
        ({"packed": "transform(packed, (b, i) -> if(i = 3, 128, b))"}, ("QuantizedValueOutOfRange", 7)),
        ({"packed": "transform(packed, (b, i) -> if(i = 16, (b & 15) | 128, b))"}, None),  # the padding nibble
        ({"scales": "transform(scales, (s, i) -> cast(3e38 as float))", "packed": "transform(packed, (b, i) -> if(i = 1, 32, 0))"}, ("DequantizedValueOverflow", 3)),
        ({}, None),
    ],
)
def test_int4_violations(table, columns, want):
    own = broken(parts.int4(table, "x", 7).filter("tensor = 'odd'"), **columns)
    assert [(r.code, r.idx) for r in parts.int4_violations(own).collect()] == ([want] if want else [])
    if want:
        with pytest.raises(TensorError, match=want[0]):
            parts.dequantize_int4(own)


@pytest.mark.parametrize(
    ("columns", "want"),
    [
        ({"global_scale": "cast('inf' as float)"}, ("InvalidGlobalScale", 0)),
        ({"global_scale": "cast(0 as float)"}, ("InvalidGlobalScale", 0)),
        ({"packed": "array_append(packed, 0)"}, ("PackedLengthMismatch", 17)),
        ({"block_scales": "slice(block_scales, 1, 2)"}, ("BlockScaleCountMismatch", 3)),
        ({"block_scales": "transform(block_scales, (b, i) -> if(i = 1, 127, b))"}, ("InvalidBlockScale", 1)),
        ({"block_scales": "transform(block_scales, (b, i) -> if(i = 2, 128, b))"}, ("InvalidBlockScale", 2)),
        ({"block_scales": "transform(block_scales, (b, i) -> if(i = 1, 0, b))", "packed": "transform(packed, (b, i) -> if(i = 9, 16, if(i = 8, 8, b)))"}, ("ZeroScaleWithNonzeroValue", 19)),
        ({"global_scale": "cast(3e38 as float)", "packed": "transform(packed, (b, i) -> if(i = 2, 7, 0))"}, ("DequantizedValueOverflow", 4)),
        ({}, None),
    ],
)
def test_nvfp4_violations(table, columns, want):
    own = broken(parts.nvfp4(table, "x").filter("tensor = 'odd'"), **columns)
    assert [(r.code, r.idx) for r in parts.nvfp4_violations(own).collect()] == ([want] if want else [])


@pytest.mark.parametrize(
    ("columns", "want"),
    [
        ({"elements": "63L"}, ("InvalidLength", 63)),
        ({"elements": "0L"}, ("InvalidLength", 0)),
        ({"data": "slice(data, 1, 67)"}, ("InvalidDataLength", 68)),
        ({"data": "transform(data, (b, i) -> if(i = 35, 124, b))"}, ("InvalidScale", 1)),
        ({}, None),
    ],
)
def test_q8_0_violations(table, columns, want):
    own = broken(parts.q8_0(table.filter("tensor = 'even'"), "x"), **columns)
    assert [(r.code, r.idx) for r in parts.q8_0_violations(own).collect()] == ([want] if want else [])


@pytest.mark.parametrize(
    ("columns", "want"),
    [
        ({"scale": "cast(0 as float)"}, ("InvalidScale", 0)),
        ({"q": "transform(q, (x, i) -> if(i in (4, 9), cast(-128 as tinyint), x))"}, ("QuantizedValueOutOfRange", 4)),
        ({"scale": "cast(3e38 as float)", "q": "transform(q, (x, i) -> cast(if(i = 6, 2, 0) as tinyint))"}, ("DequantizedValueOverflow", 6)),
        ({}, None),
    ],
)
def test_int8_violations(table, columns, want):
    own = broken(parts.int8(table, "x").filter("tensor = 'odd'"), **columns)
    assert [(r.code, r.idx) for r in parts.int8_violations(own).collect()] == ([want] if want else [])
