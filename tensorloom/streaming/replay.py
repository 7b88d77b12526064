"""INT8 on streams of chunks.

With known scales quantization is a stateless projection after a static join. Without them
the scale needs every value of a tensor, so a micro-batch must hold whole tensors. A chunk
with a value that isn't finite fails the batch with NonFiniteInput.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as n
from ..operators.arrays import amax
from ..schema import INT8_MAX


def _codes() -> Column:
    quantized = F.transform("vals", lambda v: n.quantize(v, F.col("scale"), INT8_MAX))
    failed = F.raise_error(F.concat(F.lit("NonFiniteInput: tensor "), F.col("tensor").cast("string"), F.lit(" in chunk "), F.col("chunk").cast("string")))
    return F.when(F.exists("vals", lambda v: ~n.is_finite(v)), failed).otherwise(quantized).alias("qs")


def with_scales(stream: DataFrame, scales: DataFrame) -> DataFrame:
    """(tensor, chunk, qs) of a stream of (tensor, chunk, vals), given (tensor, scale)."""
    return stream.join(scales, "tensor").select("tensor", "chunk", _codes())


def whole_tensors(stream: DataFrame, sink: Callable[[DataFrame, int], None]):  # noqa: ANN201
    """A stream writer whose batches each hold whole tensors; sink gets (tensor, chunk, scale, qs)."""

    def batch(df: DataFrame, number: int) -> None:
        scales = df.groupBy("tensor").agg(n.symmetric_scale(F.max(amax(F.col("vals"))), INT8_MAX).alias("scale"))
        rows = df.join(scales, "tensor")
        sink(rows.select("tensor", "chunk", "scale", _codes()), number)

    return stream.writeStream.foreachBatch(batch)
