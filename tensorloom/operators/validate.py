"""Value rules as a relation of violations, and the eager check that names the first one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as n
from ..schema import TensorError


def found(rows: DataFrame, bad: Column, code: str) -> DataFrame:
    """(tensor, code, idx, n): the lowest index of each tensor that breaks a rule, and how many do."""
    return rows.filter(bad).groupBy("tensor").agg(F.lit(code).alias("code"), F.min("idx").alias("idx"), F.count("*").alias("n"))


def non_finite(elements: DataFrame) -> DataFrame:
    return found(elements, ~n.is_finite(F.col("v")), "NonFiniteInput")


def unrepresentable(rows: DataFrame, v: str = "v") -> DataFrame:
    """Values without an FP4 code: NaN alone."""
    return found(rows, F.isnan(v), "NaNNotRepresentable")


def out_of_range(rows: DataFrame, low: int, high: int, code: str = "QuantizedValueOutOfRange", q: str = "q") -> DataFrame:
    return found(rows, ~F.col(q).between(low, high), code)


def bad_scales(scales: DataFrame) -> DataFrame:
    keyed = scales if "idx" in scales.columns else scales.withColumn("idx", F.col("grp") if "grp" in scales.columns else F.lit(0).cast("bigint"))
    return found(keyed, ~(n.is_finite(F.col("scale")) & (F.col("scale") > 0)), "InvalidScale")


def overflows(rows: DataFrame) -> DataFrame:
    return found(rows, ~n.is_finite(F.col("v_hat")), "DequantizedValueOverflow")


#: Tensors whose maxima the driver holds as a table to broadcast; with more they stay a relation.
MOST_TOPS = 100_000


def tops(rows: DataFrame, amax: Column, bad: Column, size: Column) -> DataFrame:
    """(tensor, amax, n) of every tensor, from one pass that also finds what isn't finite.

    bad: the index of a row's first such value, null without one. NonFiniteInput names the
    lowest index of the first tensor that has any.
    """
    found = rows.groupBy("tensor").agg(F.max(amax).alias("amax"), F.sum(size).cast("bigint").alias("n"), F.min(bad).alias("bad"))
    held = found.limit(MOST_TOPS + 1).collect()
    if len(held) > MOST_TOPS:
        check(found.filter("bad is not null").select("tensor", F.lit("NonFiniteInput").alias("code"), F.col("bad").alias("idx"), "n"))
        return found.drop("bad")
    if broken := sorted((r.tensor, r.bad) for r in held if r.bad is not None):
        raise TensorError("NonFiniteInput", f"tensor {broken[0][0]} at index {broken[0][1]}")
    return F.broadcast(rows.sparkSession.createDataFrame([tuple(r)[:3] for r in held], found.drop("bad").schema))


def element_tops(elements: DataFrame) -> DataFrame:
    """tops() of rows (tensor, idx, v); rows without idx have no place to name but 0."""
    idx = F.col("idx") if "idx" in elements.columns else F.lit(0).cast("bigint")
    return tops(elements, F.abs("v"), F.when(~n.is_finite(F.col("v")), idx), F.lit(1))


def check(*relations: DataFrame) -> None:
    """Raises for the first tensor, code and index of the given violations."""
    union = relations[0]
    for r in relations[1:]:
        union = union.unionByName(r)
    bad = union.orderBy("tensor", "idx", "code").limit(1).collect()
    if bad:
        raise TensorError(bad[0].code, f"tensor {bad[0].tensor} at index {bad[0].idx}")
