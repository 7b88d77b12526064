"""Reconstruction metrics, saturation, byte accounting and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as n
from ..schema import TensorError
from . import validate


def metric_columns(v: str = "v", v_hat: str = "v_hat") -> list[Column]:
    """elements, mse, mae, max_abs_error and sqnr_db as aggregates in float64; empty input gives zeros."""
    x = F.col(v).cast("double")
    e = x - F.col(v_hat).cast("double")
    signal, noise = F.sum(x * x), F.sum(e * e)
    return [
        F.count("*").alias("elements"),
        F.coalesce(F.avg(e * e), F.lit(0.0)).alias("mse"),
        F.coalesce(F.avg(F.abs(e)), F.lit(0.0)).alias("mae"),
        F.coalesce(F.max(F.abs(e)), F.lit(0.0)).alias("max_abs_error"),
        F.when((signal > 0) & (noise > 0), 10 * F.log10(signal / F.when(noise > 0, noise))).alias("sqnr_db"),
    ]


def saturation(qmax: int, q: str = "q") -> Column:
    """Values at either end of the symmetric range."""
    return F.count_if(F.abs(F.col(q).cast("int")) == qmax).alias("saturated_values")


def ratio(source: Column, output: Column) -> Column:
    """Null where the output has no bytes."""
    return source / F.nullif(output, F.lit(0))


def tensor_diagnostics(rows: DataFrame, qmax: int, source_width: int = 4, payload: Column | None = None, scale_bytes: Column | None = None, by: str = "tensor") -> DataFrame:
    """One row per tensor from rows with v, v_hat and q: metrics, saturation and bytes in one aggregation."""
    payload = F.col("elements") if payload is None else payload
    scale_bytes = F.lit(4) if scale_bytes is None else scale_bytes
    out = rows.groupBy(by).agg(*metric_columns(), saturation(qmax))
    out = out.withColumn("source_bytes", F.col("elements") * source_width).withColumn("quantized_bytes", (payload + scale_bytes).cast("bigint"))
    return out.withColumn("compression_ratio", ratio(F.col("source_bytes"), F.col("quantized_bytes")))


def unpaired(source: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """(tensor, source_len, rebuilt_len) of tensors whose elements don't match by place."""
    both = source.select("tensor", "idx", F.lit(1).alias("a")).join(rebuilt.select("tensor", "idx", F.lit(1).alias("b")), ["tensor", "idx"], "full_outer")
    counts = both.groupBy("tensor").agg(F.count("a").alias("source_len"), F.count("b").alias("rebuilt_len"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("odd"))
    return counts.filter("odd > 0").drop("odd")


def paired(source: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Source and reconstruction by (tensor, idx); LengthMismatch if either has elements the other lacks."""
    both = source.select("tensor", "idx", "v").join(rebuilt.select("tensor", "idx", "v_hat"), ["tensor", "idx"], "full_outer")
    odd = both.filter("v is null or v_hat is null").limit(1).collect()
    if odd:
        raise TensorError("LengthMismatch", f"tensor {odd[0].tensor} at {odd[0].idx}")
    return both


def checked_pairs(rows: DataFrame) -> DataFrame:
    """rows (tensor, idx, v, v_hat), none of whose values is NaN or infinite; the source's come first."""
    validate.check(validate.found(rows, ~n.is_finite(F.col("v")), "NonFiniteSource"), validate.found(rows, n.is_finite(F.col("v")) & ~n.is_finite(F.col("v_hat")), "NonFiniteReconstructed"))
    return rows


def reconstruction_metrics(source: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """metric_columns() by tensor of (tensor, idx, v) against (tensor, idx, v_hat): equal places, finite values."""
    return checked_pairs(paired(source, rebuilt)).groupBy("tensor").agg(*metric_columns())


def accounting(source: int, payload: int, overhead: int) -> tuple[int, float | None]:
    """(total bytes, ratio or None)."""
    total = payload + overhead
    if max(source, total) >= 1 << 64 or min(source, payload, overhead) < 0:
        raise TensorError("ByteCountOverflow", f"{payload} + {overhead}")
    return total, source / total if total else None


def model_report(diagnostics: DataFrame) -> DataFrame:
    """The worst metrics and the sums over all tensors; null SQNR is left out."""
    return diagnostics.agg(
        F.count("*").alias("quantized_tensors"),
        F.coalesce(F.sum("saturated_values"), F.lit(0)).cast("bigint").alias("saturated_values"),
        F.coalesce(F.max("mse"), F.lit(0.0)).alias("max_mse"),
        F.coalesce(F.max("mae"), F.lit(0.0)).alias("max_mae"),
        F.coalesce(F.max("max_abs_error"), F.lit(0.0)).alias("max_abs_error"),
        F.min("sqnr_db").alias("lowest_sqnr_db"),
    )


def scaled(x: Column, factor: float) -> Column:
    """A float64 metric as an integer, so that the order of summation doesn't show."""
    return F.floor(x * factor + 0.5).cast("bigint")
