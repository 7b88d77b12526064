"""The same quantizers on array rows: a tensor in each row, no shuffle at all.

A row with a value that isn't finite fails the job with NonFiniteInput and the value's index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as n
from ..schema import INT4_MAX, INT8_MAX


def amax(values: Column) -> Column:
    return F.array_max(F.transform(values, F.abs))


def _checked_amax(values: Column, base: Column) -> Column:
    """amax of finite values: what isn't finite is the largest there is, so the maximum alone tells."""
    bad = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    index = (base + F.array_position(F.transform(values, bad), True) - 1).cast("string")
    failed = F.raise_error(F.concat(F.lit("NonFiniteInput: at index "), index))
    return n.let(amax(values), lambda m: F.when(m.isNull() | n.is_finite(m), m).otherwise(failed))


def _floats(values: str) -> Column:
    return F.transform(values, lambda x: x.cast("float"))


def int8(df: DataFrame, values: str) -> DataFrame:
    """df with scale and q array<tinyint>."""
    scaled = df.withColumn("scale", n.symmetric_scale(_checked_amax(_floats(values), F.lit(0)), INT8_MAX))
    # scale is bound once a row: its expression may be put in its place, and the lambda runs for every element
    return scaled.withColumn("q", n.let(F.col("scale"), lambda s: F.transform(_floats(values), lambda x: n.quantize(x, s, INT8_MAX))))


def int4(df: DataFrame, values: str, size: int) -> DataFrame:
    """df with scales array<float> and q array<tinyint>; the last group may be short."""
    groups = F.sequence(F.lit(0), F.expr(f"cast(greatest(ceil(size({values}) / {size}) - 1, 0) as int)"))
    scale = lambda v, g: n.symmetric_scale(_checked_amax(F.slice(v, g * size + 1, size), g * size), INT4_MAX)
    scaled = df.withColumn("scales", n.let(_floats(values), lambda v: F.transform(groups, lambda g: scale(v, g))))
    return scaled.withColumn("q", n.let(F.col("scales"), lambda s: F.transform(_floats(values), lambda x, i: n.quantize(x, F.get(s, F.floor(i / size).cast("int")), INT4_MAX))))


def metrics(df: DataFrame, values: str, q: str = "q", scale: str = "scale") -> DataFrame:
    """df with elements, mse, mae, max_abs_error, sqnr_db and saturated_values of INT8 rows."""
    pairs = F.zip_with(values, q, lambda v, x: F.struct(v.cast("double").alias("v"), (v.cast("double") - n.dequantize(x, F.col(scale)).cast("double")).alias("e")))
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("s", "e", "a", "m")])
    add = lambda a, x: F.struct((a["s"] + x["v"] * x["v"]).alias("s"), (a["e"] + x["e"] * x["e"]).alias("e"), (a["a"] + F.abs(x["e"])).alias("a"), F.greatest(a["m"], F.abs(x["e"])).alias("m"))
    out = df.withColumn("sums", F.aggregate(pairs, zero, add)).withColumn("elements", F.size(values).cast("bigint"))
    count = F.greatest(F.col("elements"), F.lit(1))
    return out.select(
        *df.columns,
        "elements",
        (F.col("sums.e") / count).alias("mse"),
        (F.col("sums.a") / count).alias("mae"),
        F.col("sums.m").alias("max_abs_error"),
        F.when((F.col("sums.s") > 0) & (F.col("sums.e") > 0), 10 * F.log10(F.col("sums.s") / F.col("sums.e"))).alias("sqnr_db"),
        F.size(F.filter(q, lambda x: F.abs(x) == INT8_MAX)).cast("bigint").alias("saturated_values"),
    )
