"""Quantizers on chunks (tensor, base_idx, vals ARRAY<FLOAT>): no element is ever shuffled.

A chunk holds consecutive elements of a tensor from base_idx on. Its groups are cut out where
it lies and become block rows (tensor, grp, start, vals); a block's scale is an expression of
its row. What a format needs of a whole tensor, its largest magnitude, is one row a tensor.
Only chunks that cut a group apart, or elements in no order, are brought together first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as n
from ..schema import CHUNK_ELEMENTS, INT4_MAX, INT8_MAX, NVFP4_BLOCK, Q8_BLOCK, TensorError
from . import quantize, validate
from .arrays import amax


def tops(chunks: DataFrame) -> DataFrame:
    """(tensor, amax, n): largest magnitude and number of elements; raises for values that aren't finite."""
    place = F.array_position(F.transform("vals", n.is_finite), False)
    return validate.tops(chunks, amax(F.col("vals")), F.when(place > 0, F.col("base_idx") + place - 1), F.size("vals"))


def rechunk(chunks: DataFrame, size: int) -> DataFrame:
    """Chunks of size elements (a tensor's last may be short), each from a multiple of size on; arrays move, not elements."""
    if size < 1:
        raise TensorError("InvalidChunkSize", str(size))
    first, last = F.expr(f"base_idx div {size}"), F.expr(f"(base_idx + size(vals) - 1) div {size}")
    pieces = chunks.filter(F.size("vals") > 0).select("tensor", "base_idx", "vals", F.explode(F.sequence(first, last)).alias("chunk"))
    low = F.greatest(F.col("chunk") * size, F.col("base_idx"))
    high = F.least((F.col("chunk") + 1) * size, F.col("base_idx") + F.size("vals"))
    piece = F.slice("vals", (low - F.col("base_idx") + 1).cast("int"), (high - low).cast("int"))
    whole = pieces.select("tensor", "chunk", F.struct(low.alias("at"), piece.alias("vals")).alias("p")).groupBy("tensor", "chunk").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return whole.select("tensor", (F.col("chunk") * size).alias("base_idx"), F.flatten(F.transform("p", lambda p: p["vals"])).alias("vals"))


@dataclass(frozen=True)
class Parallel:
    """How much work a task gets. Results don't depend on it; without it chunks stay where they lie."""

    workers: int | None = None  # tasks; None: as many as the session runs at once
    chunk_elements: int = CHUNK_ELEMENTS

    def spread(self, chunks: DataFrame, group: int = 1) -> DataFrame:
        """chunks cut anew, whole groups each, and dealt to the workers by tensor and place."""
        workers = chunks.sparkSession.sparkContext.defaultParallelism if self.workers is None else self.workers
        if workers < 1 or self.chunk_elements < 1:
            raise TensorError("InvalidConfig", f"{workers} workers, chunks of {self.chunk_elements} elements")
        if group < 1:
            raise TensorError("InvalidGroupSize", str(group))
        return rechunk(chunks, -(-self.chunk_elements // group) * group).repartition(workers, "tensor", "base_idx")


def of_elements(elements: DataFrame, size: int) -> DataFrame:
    """Chunks of size elements from rows (tensor, idx, v) in any order."""
    keyed = elements.groupBy("tensor", F.expr(f"idx div {size}").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("p"))
    return keyed.select("tensor", (F.col("chunk") * size).alias("base_idx"), F.transform("p", lambda p: p["v"]).alias("vals"))


def blocks(chunks: DataFrame, size: int) -> DataFrame:
    """(tensor, grp, start, vals): the groups of size elements; base_idx must be multiples of size."""
    if size < 1:
        raise TensorError("InvalidGroupSize", str(size))
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"cast((size(vals) - 1) div {size} as int)")), lambda g: F.slice("vals", g * size + 1, size))
    out = chunks.filter(F.size("vals") > 0).select("tensor", "base_idx", F.posexplode(cut).alias("g", "vals"))
    return out.select("tensor", (F.expr(f"base_idx div {size}") + F.col("g")).alias("grp"), (F.col("base_idx") + F.col("g") * size).alias("start"), "vals")


def elements(rows: DataFrame, *columns: str) -> DataFrame:
    """(tensor, idx, grp, v) and the named columns, a row for each element of blocks."""
    out = rows.select("tensor", "grp", "start", *columns, F.posexplode("vals").alias("i", "v"))
    return out.select("tensor", (F.col("start") + F.col("i")).alias("idx"), "grp", "v", *columns)


def _checked(chunks: DataFrame, check: bool) -> DataFrame:
    if check:
        tops(chunks)
    return chunks


def int8(chunks: DataFrame, parallel: Parallel | None = None) -> DataFrame:
    """chunks with scale, one a tensor, and q array<tinyint>."""
    scales = tops(chunks).select("tensor", n.symmetric_scale(F.col("amax"), INT8_MAX).alias("scale"))
    chunks = chunks if parallel is None else parallel.spread(chunks)
    return chunks.join(scales, "tensor").withColumn("q", F.transform("vals", lambda v: n.quantize(v, F.col("scale"), INT8_MAX)))


def int4(chunks: DataFrame, size: int, check: bool = True, parallel: Parallel | None = None) -> DataFrame:
    """Blocks of size elements with scale; check: False where the values are known to be finite."""
    chunks = _checked(chunks, check)
    return blocks(chunks if parallel is None else parallel.spread(chunks, size), size).withColumn("scale", n.symmetric_scale(amax(F.col("vals")), INT4_MAX))


def int4_elements(chunks: DataFrame, size: int, check: bool = True, parallel: Parallel | None = None) -> DataFrame:
    """(tensor, idx, grp, v, scale, q)."""
    return elements(int4(chunks, size, check, parallel), "scale").withColumn("q", n.quantize(F.col("v"), F.col("scale"), INT4_MAX))


def per_channel_int8(chunks: DataFrame, width: int, check: bool = True) -> DataFrame:
    """Blocks of a matrix's rows with a scale each, and q array<tinyint>."""
    out = blocks(_checked(chunks, check), width).withColumn("scale", n.symmetric_scale(amax(F.col("vals")), INT8_MAX))
    return out.withColumn("q", n.let(F.col("scale"), lambda s: F.transform("vals", lambda v: n.quantize(v, s, INT8_MAX))))


def q8_0(chunks: DataFrame) -> DataFrame:
    """Blocks of 32 elements with exact (the float32 scale) and scale (binary16, as float)."""
    quantize.check_q8_0(tops(chunks))
    out = blocks(chunks, Q8_BLOCK).withColumn("exact", quantize.q8_0_scale(amax(F.col("vals"))))
    return out.withColumn("scale", n.to_f16(F.col("exact")))


def q8_0_elements(chunks: DataFrame) -> DataFrame:
    """(tensor, idx, grp, v, scale, q)."""
    out = elements(q8_0(chunks), "scale", "exact")
    return out.withColumn("q", quantize.q8_0_level(F.col("v"), F.col("exact"))).drop("exact")


def nvfp4(chunks: DataFrame) -> DataFrame:
    """Blocks of 16 elements with gmax, block_bits (E4M3), scale (its value) and global_scale."""
    out = blocks(chunks, NVFP4_BLOCK).join(tops(chunks).select("tensor", F.col("amax").alias("gmax")), "tensor")
    out = out.withColumn("block_bits", quantize.nvfp4_bits(amax(F.col("vals")), F.col("gmax")))
    return out.withColumn("scale", n.e4m3_decode(F.col("block_bits"))).withColumn("global_scale", quantize.nvfp4_global(F.col("gmax")))


def nvfp4_elements(chunks: DataFrame) -> DataFrame:
    """(tensor, idx, grp, v, block_bits, scale, global_scale, code)."""
    out = elements(nvfp4(chunks), "block_bits", "scale", "global_scale", "gmax")
    return out.withColumn("code", quantize.nvfp4_code(F.col("v"), F.col("gmax"), F.col("block_bits"), F.col("scale"))).drop("gmax")


def nvfp4_codes(chunks: DataFrame) -> DataFrame:
    """nvfp4() with codes array<int>."""
    code = lambda v, b, s: F.when(b == 0, 0).otherwise(n.let(quantize.nvfp4_ratio(v, F.col("gmax"), b, s), n.e2m1_encode))
    codes = n.let(F.col("block_bits"), lambda b: n.let(F.col("scale"), lambda s: F.transform("vals", lambda v: code(v, b, s))))
    return nvfp4(chunks).withColumn("codes", codes)


def packed(codes: Column) -> Column:
    """Bytes 0..255 of an array of nibbles, the first one low; an odd last one has a zero high nibble."""

    def pairs(c: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(c) - 1) / 2).cast("int"))
        return F.when(F.size(c) > 0, F.transform(places, lambda i: n.pack_pair(F.get(c, i * 2), F.get(c, i * 2 + 1)))).otherwise(F.array().cast("array<int>"))

    return n.let(codes, pairs)


def unpacked(data: Column, count: Column, signed: bool = True) -> Column:
    """The first count nibbles of an array of bytes."""
    code = lambda b, high: n.unpack_signed(b, F.lit(high)).cast("int") if signed else (F.shiftright(b, 4) if high else b.bitwiseAND(F.lit(15)))
    both = F.flatten(F.transform(data, lambda b: F.array(code(b, False), code(b, True))))
    return F.slice(both, F.lit(1), count.cast("int"))
