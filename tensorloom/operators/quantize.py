"""Quantizers on element rows (tensor, idx, v FLOAT), in any order.

Group keys come from idx, so results never depend on partitioning or file order. Every
quantizer first reads each tensor's largest magnitude, in partial and final aggregates; that
pass raises for values that aren't finite, at the lowest index. The maxima are a row a
tensor. Scales of groups are window maxima over (tensor, group): one shuffle, no join. Where
elements lie in order as arrays, blocks.py does the same without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as n
from ..schema import CHUNK_ELEMENTS, F16_MAX, FP8_MAX, INT4_HIGH, INT4_LOW, INT4_MAX, INT8_MAX, NVFP4_BLOCK, Q8_BLOCK, SMALLEST, TensorError, element_count
from . import validate

NVFP4_TOP = 2688.0  # FP4_MAX * FP8_MAX


def explode_arrays(df: DataFrame, tensor: str, values: str) -> DataFrame:
    """Element rows of array rows; each row is a tensor. Null arrays are left out."""
    return df.select(F.col(tensor).alias("tensor"), F.posexplode(values).alias("pos", "x")).select("tensor", F.col("pos").cast("bigint").alias("idx"), F.col("x").cast("float").alias("v"))


def group(size: int) -> Column:
    if size < 1:
        raise TensorError("InvalidGroupSize", str(size))
    return F.expr(f"idx div {size}")


def int8_scales(elements: DataFrame) -> DataFrame:
    """(tensor, scale); raises NonFiniteInput at the lowest index."""
    return validate.element_tops(elements).select("tensor", n.symmetric_scale(F.col("amax"), INT8_MAX).alias("scale"))


def int8_quantize(elements: DataFrame, scales: DataFrame | None = None) -> DataFrame:
    """elements with scale and q. Scales that are given must be finite and positive and fit the values."""
    given = scales is not None
    scales = scales if given else int8_scales(elements)
    rows = elements.join(scales, "tensor")
    if given:
        keyed = rows if "idx" in rows.columns else rows.withColumn("idx", F.lit(0).cast("bigint"))
        validate.check(validate.bad_scales(scales))
        validate.check(validate.non_finite(keyed), validate.found(keyed, n.is_finite(F.col("v")) & ~n.is_finite(n.div32(F.col("v"), F.col("scale"))), "QuantizedValueOverflow"))
    return rows.withColumn("q", n.quantize(F.col("v"), F.col("scale"), INT8_MAX))


def int8_replay(elements: DataFrame, scales: DataFrame | None = None, chunk: int = CHUNK_ELEMENTS) -> DataFrame:
    """int8_quantize() with the chunk of each element; the last chunk of a tensor may be short."""
    if chunk < 1:
        raise TensorError("InvalidChunkSize", str(chunk))
    return int8_quantize(elements, scales).withColumn("chunk", F.expr(f"idx div {chunk}"))


def int4_scales(elements: DataFrame, size: int) -> DataFrame:
    """(tensor, grp, scale); the last group may be short."""
    group(size)
    validate.element_tops(elements)
    return elements.groupBy("tensor", group(size).alias("grp")).agg(n.symmetric_scale(F.max(F.abs("v")), INT4_MAX).alias("scale"))


def _per_group(elements: DataFrame, size: int) -> DataFrame:
    keyed = elements.withColumn("grp", group(size))
    return keyed.withColumn("amax", F.max(F.abs("v")).over(Window.partitionBy("tensor", "grp")))


def int4_quantize(elements: DataFrame, size: int) -> DataFrame:
    """elements with grp, scale and q in -7..7."""
    group(size)
    validate.element_tops(elements)
    out = _per_group(elements, size).withColumn("scale", n.symmetric_scale(F.col("amax"), INT4_MAX)).drop("amax")
    return out.withColumn("q", n.quantize(F.col("v"), F.col("scale"), INT4_MAX))


def pack_nibbles(rows: DataFrame, code: str = "q", signed: bool | None = None) -> DataFrame:
    """(tensor, byte_idx, byte): idx div 2, low nibble first, an odd tail with a zero high nibble.

    signed says which codes are nibbles, -8..7 or 0..15; None takes both.
    """
    low, high = {True: (INT4_LOW, INT4_HIGH), False: (0, 15), None: (INT4_LOW, 15)}[signed]
    validate.check(validate.out_of_range(rows, low, high, "PackedValueOutOfRange", code))
    even = F.col("idx") % 2 == 0
    pair = rows.groupBy("tensor", F.expr("idx div 2").alias("byte_idx")).agg(F.max(F.when(even, F.col(code))).alias("low"), F.max(F.when(~even, F.col(code))).alias("high"))
    return pair.select("tensor", "byte_idx", n.pack_pair(F.col("low"), F.col("high")).alias("byte"))


def unpack_nibbles(packed: DataFrame, elements: int, signed: bool = True) -> DataFrame:
    """(tensor, idx, q) of the elements nibbles of each tensor; the padding nibble is ignored.

    Every tensor must have just the bytes that so many nibbles fill.
    """
    sizes = packed.groupBy("tensor").agg(F.count("*").alias("n"))
    wrong = sizes.filter(F.col("n") != (elements + 1) // 2)
    validate.check(wrong.select("tensor", F.lit("PackedLengthMismatch").alias("code"), F.lit(0).cast("bigint").alias("idx"), "n"))
    half = packed.select("tensor", "byte_idx", "byte", F.explode(F.array(F.lit(0), F.lit(1))).alias("h"))
    code = n.unpack_signed(F.col("byte"), F.col("h") == 1) if signed else F.when(F.col("h") == 1, F.shiftright("byte", 4)).otherwise(F.col("byte").bitwiseAND(F.lit(15)))
    out = half.select("tensor", (F.col("byte_idx") * 2 + F.col("h")).alias("idx"), code.alias("q"))
    return out.filter(F.col("idx") < elements)


def dequantize(rows: DataFrame) -> DataFrame:
    """rows with v_hat = q * scale."""
    return rows.withColumn("v_hat", n.dequantize(F.col("q"), F.col("scale")))


def q8_0_scale(amax: Column) -> Column:
    """The float32 scale of a block; zero for a block of zeros."""
    return n.div32(n.f32(amax), F.lit(127.0))


def q8_0_level(v: Column, exact: Column) -> Column:
    """The value of -127..127, by the float32 reciprocal of the exact scale."""
    safe = F.when(exact == 0, n.lit32(1.0)).otherwise(exact)
    inverse = F.when(exact == 0, n.lit32(0.0)).otherwise(n.div32(F.lit(1.0), safe))
    return n.clamp(n.round_away(n.mul32(v, inverse)), INT8_MAX)


def check_q8_0(tops: DataFrame) -> None:
    """Lengths must fill blocks, and every scale needs a finite binary16 value."""
    code = F.when(F.col("n") % Q8_BLOCK != 0, "InvalidLength").when(q8_0_scale(F.col("amax")) >= F16_MAX, "InvalidScale")
    validate.check(tops.select("tensor", code.alias("code"), F.lit(0).cast("bigint").alias("idx"), "n").filter("code is not null"))


def q8_0_quantize(elements: DataFrame) -> DataFrame:
    """elements with grp, scale (binary16 as float) and q."""
    check_q8_0(validate.element_tops(elements))
    out = _per_group(elements, Q8_BLOCK).withColumn("exact", q8_0_scale(F.col("amax")))
    out = out.withColumn("q", q8_0_level(F.col("v"), F.col("exact")))
    return out.withColumn("scale", n.to_f16(F.col("exact"))).drop("amax", "exact")


def _shaped(shape: list[int], block: int, elements: int | None) -> int:
    if not shape or 0 in shape or shape[-1] % block:
        raise TensorError("InvalidShape", str(shape))
    total = element_count(shape)
    if elements is not None and elements != total:
        raise TensorError("ShapeLengthMismatch", f"{elements} values for {shape}")
    return total


def q8_0_shape(shape: list[int], elements: int | None = None) -> int:
    """Number of elements; no dimension is zero and the last is a multiple of the block."""
    return _shaped(shape, Q8_BLOCK, elements)


def nvfp4_shape(shape: list[int], elements: int | None = None) -> int:
    """Number of elements; no dimension is zero and the last is a multiple of the block."""
    return _shaped(shape, NVFP4_BLOCK, elements)


def nvfp4_global(gmax: Column) -> Column:
    gs = n.div32(n.f32(gmax), F.lit(NVFP4_TOP))
    return F.when(gmax == 0, n.lit32(1.0)).when(gs == 0, n.lit32(SMALLEST)).otherwise(gs)


def _safe(gmax: Column) -> Column:
    return F.when(gmax == 0, n.lit32(1.0)).otherwise(gmax)


def nvfp4_bits(bmax: Column, gmax: Column) -> Column:
    """The E4M3 scale of a block; zero for a block of zeros alone."""
    bits = n.e4m3_encode(n.mul32(n.div32(bmax, _safe(gmax)), n.lit32(float(FP8_MAX))))
    return F.when(bmax == 0, 0).otherwise(F.greatest(bits, F.lit(1)))


def nvfp4_ratio(v: Column, gmax: Column, bits: Column, scale: Column) -> Column:
    """A value in units of its block's scale, as float32."""
    return n.div32(n.mul32(n.div32(v, _safe(gmax)), n.lit32(NVFP4_TOP)), F.when(bits == 0, n.lit32(1.0)).otherwise(scale))


def nvfp4_code(v: Column, gmax: Column, bits: Column, scale: Column) -> Column:
    """The E2M1 code of a value in a block; zero in a block of zeros."""
    return F.when(bits == 0, 0).otherwise(n.e2m1_encode(nvfp4_ratio(v, gmax, bits, scale)))


def nvfp4_quantize(elements: DataFrame) -> DataFrame:
    """elements with grp, block_bits (E4M3), scale (its value), global_scale and code (E2M1)."""
    tops = validate.element_tops(elements).select("tensor", F.col("amax").alias("gmax"))
    out = _per_group(elements, NVFP4_BLOCK).join(tops, "tensor").withColumn("block_bits", nvfp4_bits(F.col("amax"), F.col("gmax")))
    out = out.withColumn("scale", n.e4m3_decode(F.col("block_bits"))).withColumn("global_scale", nvfp4_global(F.col("gmax")))
    return out.withColumn("code", nvfp4_code(F.col("v"), F.col("gmax"), F.col("block_bits"), F.col("scale"))).drop("gmax", "amax")


def nvfp4_dequantize(rows: DataFrame) -> DataFrame:
    """rows with v_hat = (e2m1 * e4m3) * global_scale in float32."""
    return rows.withColumn("v_hat", n.mul32(n.mul32(n.e2m1_decode(F.col("code")), F.col("scale")), F.col("global_scale")))


def per_channel_int8(elements: DataFrame, width: int) -> DataFrame:
    """INT8 with a scale for each row of a matrix of the given width (idx div width)."""
    group(width)
    validate.element_tops(elements)
    out = _per_group(elements, width).withColumn("scale", n.symmetric_scale(F.col("amax"), INT8_MAX)).drop("amax")
    return out.withColumn("q", n.quantize(F.col("v"), F.col("scale"), INT8_MAX))
