"""Which tensors to quantize."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FLOATING, MINIMUM_ELEMENTS, TensorError


def kind(dtype: Column) -> Column:
    return F.when(dtype.isin(*FLOATING), "floating").otherwise("non-floating")


def decide(tensors: DataFrame, minimum: int = MINIMUM_ELEMENTS) -> DataFrame:
    """tensors (with dtype or kind, and element_count) plus kind, action, reason_code, minimum_elements, reason_text."""
    own = F.col("kind") if "kind" in tensors.columns else kind(F.col("dtype"))
    n = F.col("element_count")
    code = F.when(own != "floating", "NonFloating").when(n == 0, "EmptyTensor").when(n >= minimum, "FloatingMeetsMinimum").otherwise("FloatingBelowMinimum")
    text = (
        F.when(own != "floating", "non-floating tensors are preserved")
        .when(n == 0, "empty tensors are preserved")
        .when(n >= minimum, F.format_string(f"floating tensor has %d elements, meeting minimum {minimum}", n))
        .otherwise(F.format_string(f"floating tensor has %d elements, below minimum {minimum}", n))
    )
    out = tensors.withColumn("kind", own).withColumn("reason_code", code)
    return out.withColumn("action", F.when(F.col("reason_code") == "FloatingMeetsMinimum", "quantize").otherwise("preserve")).withColumn("minimum_elements", F.lit(minimum).cast("bigint")).withColumn("reason_text", text)


def check_options(output_format: str, device: str) -> None:
    if output_format != "int8":
        raise TensorError("UnsupportedFormat", f"only int8 can be written, not {output_format}")
    if device != "cpu":
        raise TensorError("UnsupportedDevice", f"only cpu is available, not {device}")
