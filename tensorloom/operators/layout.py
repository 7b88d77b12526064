"""Output layout: where each output tensor lies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FLOATING, TensorError

RESERVED = "__metadata__"


def violations(sources: DataFrame, decisions: DataFrame) -> DataFrame:
    """(code, tensor) of every rule that sources (tensor, dtype, shape, byte_len, element_count) and
    decisions (tensor, element_count, kind, action) break together."""
    found = lambda df, code: df.select(F.lit(code).alias("code"), "tensor")
    twice = lambda df: df.groupBy("tensor").count().filter("count > 1")
    both = sources.alias("s").join(decisions.alias("d"), "tensor")
    quantized = both.filter("action = 'quantize'")
    made = quantized.select(F.explode(F.array(F.concat("tensor", F.lit(".qdata")), F.concat("tensor", F.lit(".scale")))).alias("tensor"))
    out = [
        found(twice(sources), "DuplicateSourceName"),
        found(twice(decisions), "DuplicateDecisionName"),
        found(sources.join(decisions, "tensor", "left_anti"), "MissingDecision"),
        found(decisions.join(sources, "tensor", "left_anti"), "UnexpectedDecision"),
        found(sources.filter(F.col("tensor") == RESERVED), "ReservedTensorName"),
        found(both.filter("s.element_count <> d.element_count"), "DecisionElementCountMismatch"),
        found(quantized.filter("d.kind <> 'floating'"), "QuantizationRequiresFloating"),
        found(quantized.filter(~F.col("s.dtype").isin(*FLOATING)), "UnsupportedQuantizedDtype"),
        found(made.join(sources, "tensor", "left_semi").unionByName(twice(made).select("tensor")), "OutputNameCollision"),
    ]
    union = out[0]
    for x in out[1:]:
        union = union.unionByName(x)
    return union


def plan(sources: DataFrame, decisions: DataFrame, check: bool = True) -> DataFrame:
    """ord, name, source_name, dtype, shape, byte_len, data_start, data_end, role.

    Sources in the order of their names' bytes; a quantized one has two outputs, qdata (I8)
    before scale (F32, no dimensions). Metadata only: one row per tensor, so the running sum
    over all of them is a small single-partition window whatever the payloads weigh.
    """
    if check:
        bad = violations(sources, decisions).orderBy("code", "tensor").limit(1).collect()
        if bad:
            counts = sources.count(), decisions.count()
            if counts[0] != counts[1]:
                raise TensorError("DecisionCountMismatch", f"{counts[0]} sources, {counts[1]} decisions; {bad[0].code}: {bad[0].tensor}")
            raise TensorError(bad[0].code, bad[0].tensor)
        size = F.when(F.col("action") == "quantize", F.col("element_count").cast("decimal(38,0)") + 4).otherwise(F.col("byte_len").cast("decimal(38,0)"))
        total = sources.join(decisions.select("tensor", "action"), "tensor").agg(F.sum(size)).first()[0] or 0
        if total >= 1 << 63:  # offsets are signed 64-bit integers here
            raise TensorError("OutputByteLengthOverflow", str(total))
    both = sources.select("tensor", "dtype", "shape", "byte_len", "element_count").join(decisions.select("tensor", "action"), "tensor")
    none = F.array().cast("array<bigint>")
    out = lambda k, name, dtype, shape, size, role: F.struct(F.lit(k).alias("k"), name.alias("name"), dtype.alias("dtype"), shape.alias("shape"), size.cast("bigint").alias("byte_len"), F.lit(role).alias("role"))
    name = F.col("tensor")
    two = F.array(out(0, F.concat(name, F.lit(".qdata")), F.lit("I8"), F.col("shape"), F.col("element_count"), "qdata"), out(1, F.concat(name, F.lit(".scale")), F.lit("F32"), none, F.lit(4), "scale"))
    one = F.array(out(0, name, F.col("dtype"), F.col("shape"), F.col("byte_len"), "preserved"))
    rows = both.select(name.alias("source_name"), F.explode(F.when(F.col("action") == "quantize", two).otherwise(one)).alias("o")).select("source_name", "o.*")
    order = Window.orderBy("source_name", "k")
    rows = rows.withColumn("ord", F.row_number().over(order) - 1).withColumn("data_end", F.sum("byte_len").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("ord", "name", "source_name", "dtype", "shape", "byte_len", (F.col("data_end") - F.col("byte_len")).alias("data_start"), "data_end", "role")


def gaps(catalog: DataFrame) -> DataFrame:
    """Catalog rows whose data doesn't begin where the one before ends; an empty tensor stands before its neighbour."""
    order = Window.partitionBy("path").orderBy("data_start", "data_end", "tensor")
    return catalog.withColumn("expected", F.lag("data_end", 1, 0).over(order)).filter("data_start <> expected")


def overlaps(catalog: DataFrame) -> DataFrame:
    """Catalog rows that begin before the one before ends."""
    order = Window.partitionBy("path").orderBy("data_start", "data_end", "tensor")
    return catalog.withColumn("before", F.lag("data_end").over(order)).filter("data_start < before")


def same_names(planned: DataFrame, actual: DataFrame) -> bool:
    a, b = planned.select("name"), actual.select("name")
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
