"""Quantized tensors as a row each, and the rules that their parts must keep.

int4: tensor, packed array<int> (bytes), scales array<float>, elements, group_size.
nvfp4: tensor, packed, block_scales array<int> (E4M3), global_scale, elements.
q8_0: tensor, data array<int> (blocks of 34 bytes), elements.
int8: tensor, q array<tinyint>, scale.

violations of a format are rows (tensor, code, idx, n): the first rule that a tensor breaks,
in the order length, scales, values, with the lowest place where it does; n counts the
places. A row's parts are checked by expressions of that row, without a shuffle. A column
that a lambda reads for every element is bound outside of it (let): the optimizer may put
the column's own expression in its place, which would then be evaluated for every element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as n
from ..schema import INT4_MAX, INT8_MAX, NVFP4_BLOCK, Q8_BLOCK, Q8_BLOCK_BYTES
from . import quantize, validate
from .blocks import packed, unpacked


def _whole(df: DataFrame, values: str) -> DataFrame:
    """df with vals, its values as floats; raises for those that aren't finite."""
    rows = df.withColumn("vals", F.transform(values, lambda v: v.cast("float")))
    place = F.array_position(F.transform("vals", n.is_finite), False)
    bad = rows.filter(place > 0).select("tensor", F.lit("NonFiniteInput").alias("code"), (place - 1).alias("idx"), F.lit(1).cast("bigint").alias("n"))
    validate.check(bad)
    return rows


def _groups(size: int) -> Column:
    groups = F.transform(F.sequence(F.lit(0), F.expr(f"cast((size(vals) - 1) div {size} as int)")), lambda g: F.slice("vals", g * size + 1, size))
    return F.when(F.size("vals") > 0, groups).otherwise(F.array().cast("array<array<float>>"))


def _amax(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def int8(df: DataFrame, values: str) -> DataFrame:
    """(tensor, q, scale) of rows that hold a whole tensor each."""
    rows = _whole(df, values).withColumn("scale", n.symmetric_scale(_amax(F.col("vals")), INT8_MAX))
    return rows.select("tensor", F.transform("vals", lambda v: n.quantize(v, F.col("scale"), INT8_MAX)).alias("q"), "scale")


def int4(df: DataFrame, values: str, size: int) -> DataFrame:
    """(tensor, packed, scales, elements, group_size) of rows that hold a whole tensor each."""
    quantize.group(size)
    rows = _whole(df, values).withColumn("scales", F.transform(_groups(size), lambda g: n.symmetric_scale(_amax(g), INT4_MAX)))
    q = n.let(F.col("scales"), lambda s: F.transform("vals", lambda v, i: n.quantize(v, F.get(s, F.floor(i / size).cast("int")), INT4_MAX).cast("int")))
    return rows.withColumn("q", q).select("tensor", packed(F.col("q")).alias("packed"), "scales", F.size("vals").cast("bigint").alias("elements"), F.lit(size).alias("group_size"))


def nvfp4(df: DataFrame, values: str) -> DataFrame:
    """(tensor, packed, block_scales, global_scale, elements) of rows that hold a whole tensor each."""
    rows = _whole(df, values).withColumn("gmax", F.coalesce(_amax(F.col("vals")), n.lit32(0.0)))
    rows = rows.withColumn("block_scales", n.let(F.col("gmax"), lambda g: F.transform(_groups(NVFP4_BLOCK), lambda x: n.let(_amax(x), lambda a: quantize.nvfp4_bits(a, g)))))
    bits = lambda all_bits, i: F.get(all_bits, F.floor(i / NVFP4_BLOCK).cast("int"))
    code = lambda v, g, b, s: F.when(b == 0, 0).otherwise(n.let(quantize.nvfp4_ratio(v, g, b, s), n.e2m1_encode)).cast("int")
    values = lambda g, all_bits, scales: F.transform("vals", lambda v, i: n.let(bits(all_bits, i), lambda b: code(v, g, b, bits(scales, i))))
    codes = n.let(F.col("block_scales"), lambda all_bits: n.let(F.transform(all_bits, n.e4m3_decode), lambda scales: n.let(F.col("gmax"), lambda g: values(g, all_bits, scales))))
    return rows.withColumn("codes", codes).select("tensor", packed(F.col("codes")).alias("packed"), "block_scales", quantize.nvfp4_global(F.col("gmax")).alias("global_scale"), F.size("vals").cast("bigint").alias("elements"))


def q8_0_data() -> Column:
    """The blocks of vals as bytes 0..255: a binary16 scale, low byte first, then 32 values."""

    def block(g: Column) -> Column:
        def bytes_of(exact: Column) -> Column:
            head = n.let(n.let(n.to_f16(exact), n.f16_bits), lambda b: F.array(b.bitwiseAND(F.lit(255)), F.shiftright(b, 8)))
            return F.concat(head, F.transform(g, lambda v: quantize.q8_0_level(v, exact).cast("int").bitwiseAND(F.lit(255))))

        return n.let(quantize.q8_0_scale(_amax(g)), bytes_of)

    return F.flatten(F.transform(_groups(Q8_BLOCK), block))


def q8_0(df: DataFrame, values: str) -> DataFrame:
    """(tensor, data, elements) of rows that hold a whole tensor each; lengths must fill blocks."""
    rows = _whole(df, values)
    quantize.check_q8_0(rows.select("tensor", _amax(F.col("vals")).alias("amax"), F.when(F.size("vals") > 0, F.size("vals")).otherwise(1).cast("bigint").alias("n")))
    return rows.select("tensor", q8_0_data().alias("data"), F.size("vals").cast("bigint").alias("elements"))


FOUND = "struct<code:string,idx:bigint,n:bigint>"


def _first(df: DataFrame, *rules: Column) -> DataFrame:
    """(tensor, code, idx, n) of the first rule that a row breaks; a rule is a struct, null where it is kept."""
    # a filter on the struct itself would be pushed down and every part's expression evaluated in it again
    return df.select("tensor", F.explode_outer(F.array(F.coalesce(*rules))).alias("x")).filter("x is not null").select("tensor", "x.*")


def _broken(bad: Column, code: str, idx: Column, count: Column) -> Column:
    return F.when(bad, F.struct(F.lit(code).alias("code"), idx.cast("bigint").alias("idx"), count.cast("bigint").alias("n"))).otherwise(F.lit(None).cast(FOUND))


def _rule(flags: Column, code: str) -> Column:
    """Broken where a flag is set: at the place of the first one; n is their number."""
    at = lambda f: n.let(F.array_position(f, True), lambda first: _broken(first > 0, code, first - 1, F.size(F.filter(f, lambda x: x))))
    return n.let(flags, at)


def _bad_scale(s: Column) -> Column:
    return ~(n.is_finite(s) & (s > 0))


def _length(array: str, want: Column, code: str) -> Column:
    """For lengths idx is the one expected and n the one there."""
    return _broken(F.size(array) != want, code, want, F.size(array))


def _packed_length() -> Column:
    return _length("packed", F.floor((F.col("elements") + 1) / 2), "PackedLengthMismatch")


def int8_violations(df: DataFrame) -> DataFrame:
    """Scale, range of the values, overflow of what they dequantize to."""
    return _first(
        df,
        _broken(_bad_scale(F.col("scale")), "InvalidScale", F.lit(0), F.lit(1)),
        _rule(F.transform("q", lambda q: F.abs(q.cast("int")) > INT8_MAX), "QuantizedValueOutOfRange"),
        _rule(n.let(F.col("scale"), lambda s: F.transform("q", lambda q: ~n.is_finite(n.dequantize(q, s)))), "DequantizedValueOverflow"),
    )


def int4_violations(df: DataFrame) -> DataFrame:
    """Group size, lengths, scales, range of the values, overflow; a padding nibble isn't looked at."""
    size = F.col("group_size")
    codes = unpacked(F.col("packed"), F.col("elements"))
    values = n.let(F.col("scales"), lambda s: F.transform(codes, lambda c, i: n.dequantize(c, F.get(s, F.floor(i / size).cast("int")))))
    return _first(
        df,
        _broken(size < 1, "InvalidGroupSize", F.lit(0), size),
        _packed_length(),
        _length("scales", F.ceil(F.col("elements") / size), "ScaleCountMismatch"),
        _rule(F.transform("scales", _bad_scale), "InvalidScale"),
        _rule(F.transform(codes, lambda c: F.abs(c) > INT4_MAX), "QuantizedValueOutOfRange"),
        _rule(F.transform(values, lambda v: ~n.is_finite(v)), "DequantizedValueOverflow"),
    )


def nvfp4_violations(df: DataFrame) -> DataFrame:
    """Tensor scale, lengths, block scales, values in blocks of scale zero, overflow."""
    codes = unpacked(F.col("packed"), F.col("elements"), signed=False)
    zero = lambda all_bits: F.transform(codes, lambda c, i: (F.get(all_bits, F.floor(i / NVFP4_BLOCK).cast("int")) == 0) & (c % 8 != 0))
    return _first(
        df,
        _broken(_bad_scale(F.col("global_scale")), "InvalidGlobalScale", F.lit(0), F.lit(1)),
        _packed_length(),
        _length("block_scales", F.ceil(F.col("elements") / NVFP4_BLOCK), "BlockScaleCountMismatch"),
        _rule(F.transform("block_scales", lambda b: (b >= 128) | (b == 127)), "InvalidBlockScale"),
        _rule(n.let(F.col("block_scales"), zero), "ZeroScaleWithNonzeroValue"),
        _rule(F.transform(_fp4_values(codes), lambda v: ~n.is_finite(v)), "DequantizedValueOverflow"),
    )


def _fp4_values(codes: Column) -> Column:
    """What an array of E2M1 codes dequantizes to, by the row's block_scales and global_scale."""
    value = lambda c, s, g: n.mul32(n.mul32(n.e2m1_decode(c), s), g)
    place = lambda i: F.floor(i / NVFP4_BLOCK).cast("int")
    return n.let(F.transform("block_scales", n.e4m3_decode), lambda scales: n.let(F.col("global_scale"), lambda g: F.transform(codes, lambda c, i: value(c, F.get(scales, place(i)), g))))


def q8_0_violations(df: DataFrame) -> DataFrame:
    """Elements that fill blocks, as many bytes as they need, block scales that are finite."""
    blocks = F.floor(F.col("elements") / Q8_BLOCK)
    exponent = lambda data, b: F.shiftright(F.get(data, b * Q8_BLOCK_BYTES + 1), 2).bitwiseAND(F.lit(31))
    return _first(
        df,
        _broken((F.col("elements") < 1) | (F.col("elements") % Q8_BLOCK != 0), "InvalidLength", F.col("elements"), F.size("data")),
        _length("data", blocks * Q8_BLOCK_BYTES, "InvalidDataLength"),
        _rule(n.let(F.col("data"), lambda data: F.transform(F.sequence(F.lit(0), blocks.cast("int") - 1), lambda b: exponent(data, b) == 31)), "InvalidScale"),
    )


def _f16_value(bits: Column) -> Column:
    e, m = F.shiftright(bits, 10).bitwiseAND(F.lit(31)), bits.bitwiseAND(F.lit(1023))
    return F.when(e == 0, m * 2.0**-24).otherwise((1 + m / 1024) * F.pow(F.lit(2.0), (e - 15).cast("double"))).cast("float")


def dequantize_int4(df: DataFrame) -> DataFrame:
    """(tensor, v_hat array<float>) of parts that keep the rules."""
    validate.check(int4_violations(df))
    codes = unpacked(F.col("packed"), F.col("elements"))
    values = n.let(F.col("scales"), lambda s: F.transform(codes, lambda c, i: n.dequantize(c, F.get(s, F.floor(i / F.col("group_size")).cast("int")))))
    return df.select("tensor", values.alias("v_hat"))


def dequantize_nvfp4(df: DataFrame) -> DataFrame:
    """(tensor, v_hat array<float>) of parts that keep the rules."""
    validate.check(nvfp4_violations(df))
    codes = unpacked(F.col("packed"), F.col("elements"), signed=False)
    return df.select("tensor", _fp4_values(codes).alias("v_hat"))


def dequantize_q8_0(df: DataFrame) -> DataFrame:
    """(tensor, v_hat array<float>) of parts that keep the rules."""
    validate.check(q8_0_violations(df))
    signed = lambda b: F.when(b >= 128, b - 256).otherwise(b)

    def block(b: Column) -> Column:
        bits = F.get(b, F.lit(0)) + F.get(b, F.lit(1)) * 256
        return n.let(n.let(bits, _f16_value), lambda s: F.transform(F.slice(b, 3, Q8_BLOCK), lambda x: n.mul32(signed(x), s)))

    places = F.sequence(F.lit(0), F.floor(F.col("elements") / Q8_BLOCK).cast("int") - 1)
    blocks = n.let(F.col("data"), lambda data: F.transform(places, lambda k: F.slice(data, k * Q8_BLOCK_BYTES + 1, Q8_BLOCK_BYTES)))
    return df.select("tensor", F.flatten(F.transform(blocks, block)).alias("v_hat"))
