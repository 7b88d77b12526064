"""Scalar quantization arithmetic as Columns, bit-exact in float32.

A float32 division is a float64 division rounded once to float32, which is exact for
float32 operands. All of these stay inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SMALLEST

FLOAT = "float"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda variable, not an expression that is written out again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def f32(x: Column) -> Column:
    return x.cast(FLOAT)


def lit32(x: float) -> Column:
    return F.lit(x).cast(FLOAT)


def div32(a: Column, b: Column) -> Column:
    return f32(a.cast("double") / b.cast("double"))


def mul32(a: Column, b: Column) -> Column:
    return f32(a) * f32(b)


def round_away(x: Column) -> Column:
    """Nearest integer, ties away from zero, as double."""
    d = x.cast("double")
    return F.signum(d) * F.floor(F.abs(d) + F.lit(0.5))


def is_finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def symmetric_scale(amax: Column, qmax: int) -> Column:
    """amax / qmax; 1 for zero or nothing; the smallest float32 where the quotient underflows."""
    s = div32(f32(amax), F.lit(float(qmax)))
    return F.when(F.coalesce(amax, F.lit(0.0)) == 0, lit32(1.0)).when(s == 0, lit32(SMALLEST)).otherwise(s)


def clamp(x: Column, qmax: int) -> Column:
    return F.greatest(F.lit(float(-qmax)), F.least(F.lit(float(qmax)), x)).cast("tinyint")


def quantize(v: Column, scale: Column, qmax: int) -> Column:
    return clamp(round_away(div32(v, scale)), qmax)


def dequantize(q: Column, scale: Column) -> Column:
    return mul32(q, scale)


def _floor_log2(x: Column) -> Column:
    return F.floor(F.log2(x))


def _exp2(e: Column) -> Column:
    return F.pow(F.lit(2.0), e.cast("double"))


def to_f16(v: Column) -> Column:
    """The nearest binary16 value as float, ties to even; infinite beyond its range."""
    x = F.abs(v.cast("double"))
    safe = F.when(x > 0, x).otherwise(F.lit(1.0))
    e = F.greatest(_floor_log2(safe), F.lit(-14))
    near = F.rint(x / _exp2(e - 10)) * _exp2(e - 10)
    mag = F.when(x == 0, 0.0).when(x >= 65520.0, float("inf")).otherwise(near)
    return f32(F.when(v < 0, -mag).otherwise(mag))


def f16_bits(v: Column) -> Column:
    """The 16 bits of a binary16 value held as float, at least zero."""
    x = v.cast("double")
    safe = F.when((x > 0) & (x < float("inf")), x).otherwise(F.lit(1.0))
    e = _floor_log2(safe)
    normal = (e + 15) * 1024 + (safe / _exp2(e) - 1) * 1024
    code = F.when(x == 0, 0.0).when(x == float("inf"), 31744.0).when(x < 2.0**-14, x * 2.0**24).otherwise(normal)
    return code.cast("int")


def is_negative(v: Column) -> Column:
    """Whether the sign bit is set, of -0.0 too."""
    return v.cast("string").startswith("-")


def e2m1_encode(v: Column) -> Column:
    """FP4 code 0..15, ties to even, saturating; null for NaN."""
    x = F.abs(v.cast("double"))
    steps = [x > 0.25, x >= 0.75, x > 1.25, x >= 1.75, x > 2.5, x >= 3.5, x > 5.0]
    mag = sum((s.cast("int") for s in steps), F.lit(0))
    return F.when(~F.isnan(v), mag + F.when(is_negative(v), 8).otherwise(0))


#: Magnitudes of the eight FP4 codes (fixed values).
E2M1 = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0)


def e2m1_decode(code: Column) -> Column:
    mag = F.get(F.array(*[F.lit(x) for x in E2M1]), (code % 8).cast("int"))
    return f32(F.when(code >= 8, -mag).otherwise(mag))


def _fp8_encode(v: Column, mantissa: int, bias: int, top: float, inf: int) -> Column:
    x = F.abs(v.cast("double"))
    finite = F.when((x > 0) & (x < float("inf")) & ~F.isnan(x), x).otherwise(F.lit(1.0))
    low = 1 - bias
    e = F.greatest(_floor_log2(finite), F.lit(low))
    near = F.least(F.rint(finite / _exp2(e - mantissa)) * _exp2(e - mantissa), F.lit(float(top)))
    k = _floor_log2(F.when(near > 0, near).otherwise(F.lit(1.0)))
    normal = (k + bias) * (1 << mantissa) + (near / _exp2(k) - 1) * (1 << mantissa)
    code = F.when(near < 2.0**low, near * 2.0 ** (mantissa - low)).otherwise(normal)
    mag = F.when(x == 0, 0.0).when(x == float("inf"), float(inf)).otherwise(code).cast("int")
    return F.when(F.isnan(v), 0x7F).otherwise(mag + F.when(is_negative(v), 128).otherwise(0))


def e4m3_encode(v: Column) -> Column:
    """FP8 E4M3 code, ties to even, saturating at 448; NaN is 0x7f."""
    return _fp8_encode(v, 3, 7, 448.0, 0x7E)


def e5m2_encode(v: Column) -> Column:
    """FP8 E5M2 code, ties to even, saturating at 57344; NaN is 0x7f."""
    return _fp8_encode(v, 2, 15, 57344.0, 0x7B)


def e4m3_decode(code: Column) -> Column:
    c = code % 128
    e, m = F.floor(c / 8), c % 8
    mag = F.when(c == 127, float("nan")).when(e == 0, m * 2.0**-9).otherwise((1 + m / 8) * _exp2(e - 7))
    return f32(F.when((code >= 128) & (c != 127), -mag).otherwise(mag))


def e5m2_decode(code: Column) -> Column:
    c = code % 128
    e, m = F.floor(c / 4), c % 4
    mag = F.when((e == 31) & (m == 0), float("inf")).when(e == 31, float("nan")).when(e == 0, m * 2.0**-16).otherwise((1 + m / 4) * _exp2(e - 15))
    return f32(F.when((code >= 128) & ~((e == 31) & (m != 0)), -mag).otherwise(mag))


def pack_pair(low: Column, high: Column) -> Column:
    """Two nibbles as a byte 0..255, the first one low; a missing one is 0."""
    nibble = lambda x: F.coalesce(x.cast("int"), F.lit(0)).bitwiseAND(F.lit(15))
    return nibble(low).bitwiseOR(F.shiftleft(nibble(high), 4))


def unpack_signed(byte: Column, high: Column) -> Column:
    n = F.when(high, F.shiftright(byte, 4)).otherwise(byte.bitwiseAND(F.lit(15)))
    return F.when(n >= 8, n - 16).otherwise(n).cast("tinyint")

