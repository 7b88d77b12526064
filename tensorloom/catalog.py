"""Queries over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .functions import numeric as n
from .operators import arrays, blocks, diagnostics, layout, parts, policy, validate
from .operators import quantize as q
from .plans import model
from .schema import CHUNK_ELEMENTS, INT4_MAX, INT8_MAX
from .sources import gguf, safetensors, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = oracles.SQL

#: Columns used where order doesn't matter, and one with a dense key where it does.
LOOSE = ["lineitem.l_quantity", "lineitem.l_extendedprice", "lineitem.l_discount", "lineitem.l_tax"]
ORDERED = "orders.o_totalprice"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _d(name: str) -> Column:
    return F.col(name).cast("double").alias(name)


def _i(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def _metrics() -> list[Column]:
    """Metrics as integers where the order of a float64 sum could show."""
    s = diagnostics.scaled
    return [_i("elements"), s(F.col("mse"), 1e12).alias("mse_e12"), s(F.col("mae"), 1e12).alias("mae_e12"), _d("max_abs_error"), s(F.col("sqnr_db"), 1e6).alias("sqnr_e6")]


def _vectors8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings quantized in place: tensor, embedding, scale, q."""
    rows = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tensor"), "embedding")
    return arrays.int8(rows, "embedding")


def _values(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("tensor", *columns, F.posexplode("q").alias("idx", "q"))


@query
def int8_scale_per_vector(spark, sf_dir):
    return _vectors8(spark, sf_dir).select("tensor", _d("scale"))


@query
def int8_quantize_values(spark, sf_dir):
    return _values(_vectors8(spark, sf_dir)).select("tensor", _i("idx"), _i("q"))


@query
def int8_dequantize(spark, sf_dir):
    out = q.dequantize(_values(_vectors8(spark, sf_dir), "scale"))
    return out.select("tensor", _i("idx"), _d("v_hat"))


@query
def int8_roundtrip_metrics(spark, sf_dir):
    rows = arrays.metrics(_vectors8(spark, sf_dir), "embedding")
    rows = rows.withColumn("source_bytes", F.col("elements") * 4).withColumn("quantized_bytes", F.col("elements") + 4)
    return rows.select("tensor", *_metrics(), _i("saturated_values"), "source_bytes", "quantized_bytes", diagnostics.ratio(F.col("source_bytes"), F.col("quantized_bytes")).alias("compression_ratio"))


@query
def int8_roundtrip_elements(spark, sf_dir):
    rows = q.dequantize(q.int8_quantize(tables.vectors(spark, sf_dir)))
    out = diagnostics.tensor_diagnostics(rows, INT8_MAX)
    return out.select("tensor", *_metrics(), _i("saturated_values"), "source_bytes", "quantized_bytes", "compression_ratio")


@query
def int8_roundtrip_columns(spark, sf_dir):
    rows = q.dequantize(q.int8_quantize(tables.columns(spark, sf_dir, LOOSE)))
    s, out = diagnostics.scaled, diagnostics.tensor_diagnostics(rows, INT8_MAX)
    return out.select("tensor", _i("elements"), s(F.col("mse"), 1e4).alias("mse_e4"), s(F.col("mae"), 1e4).alias("mae_e4"), _d("max_abs_error"), s(F.col("sqnr_db"), 1e5).alias("sqnr_e5"), _i("saturated_values"), "quantized_bytes")


@query
def int8_saturation_count(spark, sf_dir):
    return _values(_vectors8(spark, sf_dir)).groupBy("tensor").agg(diagnostics.saturation(INT8_MAX))


@query
def int8_global_scale_matrix(spark, sf_dir):
    rows = blocks.int8(tables.matrix_chunks(spark, sf_dir)).select("scale", F.explode("q").alias("q"))
    return rows.groupBy("q").agg(F.count("*").alias("n"), F.max("scale").cast("double").alias("scale")).select(_i("q"), "n", "scale")


@query
def int8_parallel(spark, sf_dir):
    """The whole matrix in chunks of 1000 elements, dealt to five workers."""
    rows = blocks.int8(tables.matrix_chunks(spark, sf_dir), blocks.Parallel(5, 1000)).select("base_idx", F.posexplode("q").alias("i", "q"))
    return rows.select((F.col("base_idx") + F.col("i")).alias("idx"), _i("q"))


@query
def int8_chunked_replay(spark, sf_dir):
    rows = q.int8_replay(tables.matrix(spark, sf_dir), chunk=CHUNK_ELEMENTS)
    return rows.groupBy("chunk").agg(F.count("*").alias("n"), F.min("q").cast("bigint").alias("min_q"), F.max("q").cast("bigint").alias("max_q"), F.sum("q").cast("bigint").alias("sum_q"))


@query
def int8_per_channel(spark, sf_dir):
    rows = blocks.per_channel_int8(tables.matrix_chunks(spark, sf_dir), 64)
    return rows.select("grp", _d("scale"), F.aggregate("q", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("sum_q"))


def _hex() -> Column:
    return F.lower(F.lpad(F.hex("byte"), 2, "0")).alias("hex")


def _cut31(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix in chunks that hold whole groups of 31."""
    return blocks.rechunk(tables.matrix_chunks(spark, sf_dir), 31 * 512)


def _tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings, each a tensor in a row."""
    return tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tensor"), "embedding")


def _packed4(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """Orders' prices in chunks of whole groups, packed: base_idx, packed, elements."""
    chunks = blocks.of_elements(tables.ordered_column(spark, sf_dir, ORDERED), size * 512)
    blocks.tops(chunks)
    return arrays.int4(chunks, "vals", size).select("base_idx", blocks.packed(F.col("q")).alias("packed"), F.size("q").alias("elements"))


@query
def int4_group_scales_32(spark, sf_dir):
    return blocks.int4(tables.matrix_chunks(spark, sf_dir), 32).select("grp", _d("scale"))


@query
def int4_group_scales_31(spark, sf_dir):
    return blocks.int4(_cut31(spark, sf_dir), 31).select("grp", _d("scale"))


@query
def int4_quantize_values(spark, sf_dir):
    return blocks.int4_elements(_cut31(spark, sf_dir), 31).select("idx", _i("q"))


@query
def int4_parallel(spark, sf_dir):
    """Groups of 31 elements, which the matrix's own chunks cut apart, dealt to five workers."""
    return blocks.int4_elements(tables.matrix_chunks(spark, sf_dir), 31, parallel=blocks.Parallel(5, 1000)).select("idx", _i("q"))


@query
def int4_dequantize(spark, sf_dir):
    return q.dequantize(blocks.int4_elements(_cut31(spark, sf_dir), 31)).select("idx", _d("v_hat"))


@query
def int4_pack_hex(spark, sf_dir):
    """A group of 31 crosses bytes; orders end in an odd or short group."""
    return _packed4(spark, sf_dir, 31).select((F.col("base_idx") / 2).cast("bigint").alias("at"), F.posexplode("packed").alias("i", "byte")).select((F.col("at") + F.col("i")).alias("byte_idx"), _hex())


@query
def int4_unpack(spark, sf_dir):
    rows = _packed4(spark, sf_dir, 128).select("base_idx", F.posexplode(blocks.unpacked(F.col("packed"), F.col("elements"))).alias("i", "q"))
    return rows.select((F.col("base_idx") + F.col("i")).alias("idx"), _i("q"))


@query
def int4_roundtrip_metrics(spark, sf_dir):
    vectors = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tensor"), F.lit(0).cast("bigint").alias("base_idx"), F.col("embedding").alias("vals"))
    rows = q.dequantize(blocks.int4_elements(vectors, 32))
    size = F.ceil(F.col("elements") / 2)
    out = diagnostics.tensor_diagnostics(rows, INT4_MAX, payload=size, scale_bytes=F.ceil(F.col("elements") / 32) * 4)
    return out.select("tensor", *_metrics(), _i("saturated_values"), "quantized_bytes", "compression_ratio")


@query
def int4_array_scales(spark, sf_dir):
    rows = arrays.int4(tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tensor"), "embedding"), "embedding", 24)
    return rows.select("tensor", F.posexplode("scales").alias("grp", "scale")).select("tensor", _i("grp"), _d("scale"))


@query
def q8_0_block_scales(spark, sf_dir):
    return blocks.q8_0(tables.matrix_chunks(spark, sf_dir)).select("grp", _d("scale"), n.f16_bits(F.col("scale")).cast("bigint").alias("bits"))


@query
def q8_0_quantize(spark, sf_dir):
    return blocks.q8_0_elements(tables.matrix_chunks(spark, sf_dir)).select("idx", _i("q"))


@query
def q8_0_dequantize(spark, sf_dir):
    return q.dequantize(blocks.q8_0_elements(tables.matrix_chunks(spark, sf_dir))).select("idx", _d("v_hat"))


def _fp4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.nvfp4_elements(tables.matrix_chunks(spark, sf_dir))


@query
def nvfp4_block_scales(spark, sf_dir):
    return blocks.nvfp4(tables.matrix_chunks(spark, sf_dir)).select("grp", _i("block_bits"), _d("global_scale"))


@query
def nvfp4_codes(spark, sf_dir):
    return _fp4(spark, sf_dir).select("idx", _i("code"))


@query
def nvfp4_pack_hex(spark, sf_dir):
    rows = blocks.nvfp4_codes(tables.matrix_chunks(spark, sf_dir)).select("start", F.posexplode(blocks.packed(F.col("codes"))).alias("i", "byte"))
    return rows.select((F.expr("start div 2") + F.col("i")).alias("byte_idx"), _hex())


@query
def nvfp4_unpack(spark, sf_dir):
    """Codes of each vector, packed and unpacked as unsigned nibbles."""
    rows = parts.nvfp4(_tensors(spark, sf_dir), "embedding")
    codes = blocks.unpacked(F.col("packed"), F.col("elements"), signed=False)
    return rows.select("tensor", F.posexplode(codes).alias("idx", "code")).select("tensor", _i("idx"), _i("code"))


@query
def nvfp4_dequantize(spark, sf_dir):
    return q.nvfp4_dequantize(_fp4(spark, sf_dir)).select("idx", _d("v_hat"))


@query
def nvfp4_metrics(spark, sf_dir):
    return q.nvfp4_dequantize(_fp4(spark, sf_dir)).groupBy("tensor").agg(*diagnostics.metric_columns()).select("tensor", *_metrics())


def _decoded(spark: SparkSession, size: int, decode: Callable[[Column], Column]) -> DataFrame:
    rows = spark.range(size).select(F.col("id").alias("code"), decode(F.col("id")).alias("x"))
    return rows.select("code", F.when(F.isnan("x"), "nan").when(F.abs("x") == float("inf"), "inf").otherwise("finite").alias("kind"), F.when(n.is_finite(F.col("x")), F.col("x").cast("double")).alias("value"), (n.is_negative(F.col("x")) & ~F.isnan("x")).alias("negative"))


@query
def fp4_e2m1_decode_table(spark, sf_dir):
    return _decoded(spark, 16, n.e2m1_decode)


@query
def fp8_e4m3_decode_table(spark, sf_dir):
    return _decoded(spark, 256, n.e4m3_decode)


@query
def fp8_e5m2_decode_table(spark, sf_dir):
    return _decoded(spark, 256, n.e5m2_decode)


@query
def float_encode_columns(spark, sf_dir):
    """FP4 and FP8 codes of column values, scaled so that small and saturating ones occur."""
    rows = tables.ordered_column(spark, sf_dir, "customer.c_acctbal")
    v = n.mul32(F.col("v"), n.lit32(0.001))
    rows = rows.select("idx", "v", v.alias("small"))
    return rows.select("idx", n.e2m1_encode(F.col("small")).cast("bigint").alias("e2m1"), n.e4m3_encode(F.col("small")).cast("bigint").alias("e4m3_small"), n.e4m3_encode(F.col("v")).cast("bigint").alias("e4m3"), n.e5m2_encode(F.col("v")).cast("bigint").alias("e5m2"))


@query
def codec_roundtrip_exhaustive(spark, sf_dir):
    """Every finite code decodes to a value that encodes to the same code."""
    codes = spark.range(256).select(F.col("id").alias("code"))
    kinds = [("e2m1", 16, n.e2m1_decode, n.e2m1_encode), ("e4m3", 256, n.e4m3_decode, n.e4m3_encode), ("e5m2", 256, n.e5m2_decode, n.e5m2_encode)]
    out = None
    for name, size, decode, encode in kinds:
        rows = codes.filter(F.col("code") < size).withColumn("x", decode(F.col("code"))).filter(n.is_finite(F.col("x")))
        rows = rows.select(F.lit(name).alias("codec"), "code", encode(F.col("x")).cast("bigint").alias("back"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def policy_decisions(spark, sf_dir):
    return policy.decide(tables.catalog(spark, sf_dir)).select("tensor", "element_count", "kind", "action", "reason_code", "reason_text")


@query
def policy_threshold_sweep(spark, sf_dir):
    catalog, out = tables.catalog(spark, sf_dir), None
    for minimum in (0, 100, 1024, 100_000):
        rows = policy.decide(catalog, minimum).groupBy("minimum_elements", "action").agg(F.count("*").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def catalog_inspect(spark, sf_dir):
    return tables.catalog(spark, sf_dir).select("tensor", "dtype", F.array_join(F.transform("shape", lambda x: x.cast("string")), "x").alias("shape"), "element_count", "byte_len")


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = tables.catalog(spark, sf_dir)
    return layout.plan(catalog, policy.decide(catalog).select("tensor", "element_count", "kind", "action"))


@query
def layout_plan(spark, sf_dir):
    return _planned(spark, sf_dir).select(_i("ord"), "name", "source_name", "dtype", "byte_len", _i("data_start"), _i("data_end"), "role")


@query
def layout_contiguity_check(spark, sf_dir):
    """A plan has no gaps; moved by a byte here and there it has."""
    rows = _planned(spark, sf_dir).select(F.lit("p").alias("path"), F.col("name").alias("tensor"), (F.col("data_start") + F.when(F.col("ord") % 5 == 4, 1).otherwise(0)).alias("data_start"), "data_end")
    return layout.gaps(rows).select("tensor", _i("data_start"), _i("expected"))


@query
def layout_overlap_check(spark, sf_dir):
    rows = _planned(spark, sf_dir).select(F.lit("p").alias("path"), F.col("name").alias("tensor"), (F.col("data_start") - F.when(F.col("ord") % 4 == 3, 2).otherwise(0)).alias("data_start"), "data_end")
    return layout.overlaps(rows).select("tensor", _i("data_start"))


@query
def layout_duplicate_check(spark, sf_dir):
    rows = tables.catalog(spark, sf_dir).select("tensor")
    return rows.unionByName(rows.filter(F.col("tensor").startswith("l"))).groupBy("tensor").agg(F.count("*").alias("n")).filter("n > 1")


@query
def decision_anti_joins(spark, sf_dir):
    """Decisions that lack a tensor, name another one and disagree about a size."""
    catalog = tables.catalog(spark, sf_dir)
    d = policy.decide(catalog).select("tensor", "element_count", "kind", "action")
    d = d.filter("tensor <> 'events.value'").withColumn("element_count", F.when(F.col("tensor") == "part.p_size", F.col("element_count") + 1).otherwise(F.col("element_count")))
    extra = d.filter("tensor = 'part.p_size'").withColumn("tensor", F.lit("unknown"))
    return layout.violations(catalog, d.unionByName(extra))


@query
def compression_accounting(spark, sf_dir):
    rows = tables.catalog(spark, sf_dir).filter("dtype = 'F32'")
    c = F.col("element_count")
    sizes = {"int8": c + 4, "int4_128": F.ceil(c / 2) + 4 * F.ceil(c / 128), "q8_0": F.ceil(c / 32) * 34, "nvfp4": F.ceil(c / 2) + F.ceil(c / 16) + 4}
    out = rows.select("tensor", F.col("byte_len").alias("source_bytes"), F.explode(F.array(*[F.struct(F.lit(k).alias("format"), x.cast("bigint").alias("total_bytes")) for k, x in sizes.items()])).alias("f")).select("tensor", "source_bytes", "f.*")
    return out.withColumn("ratio", diagnostics.ratio(F.col("source_bytes"), F.col("total_bytes")))


@query
def compression_report(spark, sf_dir):
    return _planned(spark, sf_dir).groupBy("role").agg(F.count("*").alias("tensors"), F.sum("byte_len").cast("bigint").alias("bytes"))


@query
def model_report(spark, sf_dir):
    """Roll-up over the tensors of the tables that the policy quantizes, the embedding matrix among them."""
    decided = policy.decide(tables.catalog(spark, sf_dir)).filter("action = 'quantize'")
    rows = q.dequantize(q.int8_quantize(tables.values(spark, sf_dir, [r.tensor for r in decided.select("tensor").collect()])))
    r, s = diagnostics.model_report(diagnostics.tensor_diagnostics(rows, INT8_MAX)), diagnostics.scaled
    return r.select("quantized_tensors", "saturated_values", s(F.col("max_mse"), 1e3).alias("max_mse_e3"), s(F.col("max_mae"), 1e3).alias("max_mae_e3"), _d("max_abs_error"), s(F.col("lowest_sqnr_db"), 1e5).alias("lowest_sqnr_e5"))


@query
def validate_finite(spark, sf_dir):
    """The lowest offending index of each vector in which some values were made NaN or infinite."""
    i = F.col("tensor") * 64 + F.col("idx")
    bad = F.when(i % 97 == 5, float("nan")).when(i % 131 == 7, float("-inf")).otherwise(F.col("v")).cast("float")
    return validate.non_finite(tables.vectors(spark, sf_dir).withColumn("v", bad))


@query
def validate_ranges(spark, sf_dir):
    """Values of an INT8 relation beyond the INT4 range, by tensor."""
    return validate.out_of_range(_values(_vectors8(spark, sf_dir)).select("tensor", _i("idx"), "q"), -8, 7)


@query
def preserved_identity_check(spark, sf_dir):
    """Values of a dequantized column that are the source's own."""
    rows = q.dequantize(q.int8_quantize(tables.ordered_column(spark, sf_dir, "part.p_retailprice")))
    both = diagnostics.paired(rows.select("tensor", "idx", "v"), rows.select("tensor", "idx", "v_hat"))
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("v") == F.col("v_hat")).alias("same"))


@query
def length_mismatch_check(spark, sf_dir):
    """Places that a source and its reconstruction don't share: vectors cut short, made longer or absent."""
    source = tables.vectors(spark, sf_dir)
    cut = (F.col("tensor") % 7 == 3) & (F.col("idx") >= 60) | (F.col("tensor") % 11 == 5)
    more = source.filter((F.col("tensor") % 13 == 4) & (F.col("idx") < 2)).withColumn("idx", F.col("idx") + 64)
    rebuilt = source.filter(~cut).unionByName(more).withColumnRenamed("v", "v_hat")
    return diagnostics.unpaired(source, rebuilt)


@query
def reconstruction_check(spark, sf_dir):
    """Metrics by tensor of orders' prices against prices that went through Q8_0, joined by position."""
    source = tables.ordered_column(spark, sf_dir, ORDERED).filter("idx < 1472")
    rebuilt = q.dequantize(blocks.q8_0_elements(blocks.of_elements(source, CHUNK_ELEMENTS))).select("tensor", "idx", "v_hat")
    out, s = diagnostics.reconstruction_metrics(source, rebuilt), diagnostics.scaled
    return out.select("tensor", _i("elements"), s(F.col("mse"), 1e4).alias("mse_e4"), s(F.col("mae"), 1e4).alias("mae_e4"), _d("max_abs_error"), s(F.col("sqnr_db"), 1e5).alias("sqnr_e5"))


#: How a vector's parts are damaged, by its number modulo 8: what the rules must find.
def _damaged(rows: DataFrame, **damage: dict[int, str]) -> DataFrame:
    for name, by in damage.items():
        x = F.col(name)
        for k, text in by.items():
            x = F.when(F.col("tensor") % 8 == k, F.expr(text)).otherwise(x)
        rows = rows.withColumn(name, x)
    return rows


@query
def int8_parts_check(spark, sf_dir):
    rows = parts.int8(_tensors(spark, sf_dir), "embedding")
    rows = _damaged(rows, scale={1: "cast('nan' as float)", 2: "cast(0 as float)", 3: "cast(3e38 as float)"}, q={4: "transform(q, (x, i) -> if(i % 20 = 9, cast(-128 as tinyint), x))"})
    return parts.int8_violations(rows)


@query
def int4_parts_check(spark, sf_dir):
    rows = parts.int4(_tensors(spark, sf_dir), "embedding", 24)
    rows = _damaged(
        rows,
        packed={1: "slice(packed, 1, 31)", 2: "array_append(packed, 0)", 5: "transform(packed, (b, i) -> if(i in (6, 20), 128, b))"},
        scales={3: "slice(scales, 1, 2)", 4: "transform(scales, (s, i) -> if(i > 0, cast(-1 as float), s))", 6: "transform(scales, s -> cast(3e38 as float))"},
    )
    return parts.int4_violations(rows)


@query
def nvfp4_parts_check(spark, sf_dir):
    rows = parts.nvfp4(_tensors(spark, sf_dir), "embedding")
    rows = _damaged(
        rows,
        global_scale={1: "cast('inf' as float)", 6: "cast(3e38 as float)"},
        packed={2: "slice(packed, 1, 30)", 5: "transform(packed, (b, i) -> if(i between 16 and 23, if(i = 18, 16, 136), b))"},
        block_scales={3: "array_append(block_scales, 8)", 4: "transform(block_scales, (b, i) -> if(i in (1, 3), 127, b))", 5: "transform(block_scales, (b, i) -> if(i = 2, 0, b))"},
    )
    return parts.nvfp4_violations(rows)


@query
def q8_0_parts_check(spark, sf_dir):
    rows = parts.q8_0(_tensors(spark, sf_dir), "embedding")
    rows = _damaged(rows, elements={1: "63L", 2: "96L"}, data={3: "slice(data, 1, 60)", 4: "transform(data, (b, i) -> if(i = 35, 252, b))"})
    return parts.q8_0_violations(rows)


@query
def parts_dequantize(spark, sf_dir):
    """What the parts of each vector dequantize to, in three formats."""
    t = _tensors(spark, sf_dir)
    made = {"int4_24": parts.dequantize_int4(parts.int4(t, "embedding", 24)), "nvfp4": parts.dequantize_nvfp4(parts.nvfp4(t, "embedding")), "q8_0": parts.dequantize_q8_0(parts.q8_0(t, "embedding"))}
    out = None
    for name, rows in made.items():
        rows = rows.select(F.lit(name).alias("format"), "tensor", F.posexplode("v_hat").alias("idx", "v_hat")).select("format", "tensor", _i("idx"), _d("v_hat"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def given_scale_replay(spark, sf_dir):
    """INT8 of the matrix in chunks with a scale that was known before, from a tenth of it."""
    rows = tables.matrix(spark, sf_dir)
    scales = q.int8_scales(rows.filter("idx % 10 = 0"))
    out = q.int8_replay(rows, scales.select("tensor", "scale"))
    return out.groupBy("chunk").agg(F.count("*").alias("n"), F.sum("q").cast("bigint").alias("sum_q"), diagnostics.saturation(INT8_MAX))


@query
def format_comparison(spark, sf_dir):
    """Errors of the four formats on the matrix side by side."""
    m = tables.matrix_chunks(spark, sf_dir)
    int8 = blocks.int8(m).select("scale", F.explode(F.arrays_zip("vals", "q")).alias("x")).select(F.col("x.vals").alias("v"), F.col("x.q").alias("q"), "scale")
    made = {"int8": q.dequantize(int8), "int4_32": q.dequantize(blocks.int4_elements(m, 32)), "q8_0": q.dequantize(blocks.q8_0_elements(m)), "nvfp4": q.nvfp4_dequantize(blocks.nvfp4_elements(m))}
    out = None
    for name, rows in made.items():
        rows = rows.select(F.lit(name).alias("format"), "v", "v_hat")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("format").agg(*diagnostics.metric_columns()).select("format", *_metrics())


def _folder(spark: SparkSession) -> str:
    """A folder for container files that the driver and the executors reach as a path."""
    named = spark.conf.get("spark.checkpoint.dir", None) or ""
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tensorloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        return own
    if not named.startswith(("/", "file:/")):
        raise RuntimeError(f"container files need a mounted folder, not {named}")
    out = f"/{named.removeprefix('file:').lstrip('/')}/containers-{uuid.uuid4().hex}"
    os.makedirs(out)
    return out


#: Tensors of the container that is written from the tables.
CONTAINED = {"customer.c_acctbal": "F32", "orders.o_totalprice": "F32", "part.p_retailprice": "F32", "supplier.s_acctbal": "F32", "nation.n_nationkey": "I32", "region.r_regionkey": "I32"}


def container(spark: SparkSession, sf_dir: str, path: str, names: list[str]) -> None:
    """A SafeTensors file of some of CONTAINED and the embedding matrix, written from the tables."""
    sizes = {r.tensor: list(r.shape) for r in tables.catalog(spark, sf_dir).collect()}
    parts = []
    if tables.MATRIX in names:
        parts.append(safetensors.to_bytes(tables.matrix_chunks(spark, sf_dir).select(F.lit(tables.MATRIX).alias("tensor"), F.col("base_idx").alias("chunk"), "vals"), "vals", "<f4"))
    keys = {"nation.n_nationkey": "n_nationkey", "region.r_regionkey": "r_regionkey"}
    for name, dtype in CONTAINED.items():
        if name not in names:
            continue
        table, column = name.split(".")
        key = keys.get(name) or tables.COLUMNS[name]
        rows = tables.table(spark, sf_dir, table)
        # runs of the table's key; each becomes an array where its rows meet
        runs = rows.groupBy(F.expr(f"{key} div {CHUNK_ELEMENTS}").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(column).cast("float" if dtype == "F32" else "int").alias("v")))).alias("p"))
        parts.append(safetensors.to_bytes(runs.select(F.lit(name).alias("tensor"), "chunk", F.transform("p", lambda p: p["v"]).alias("v")), "v", "<f4" if dtype == "F32" else "<i4"))
    safetensors.write_tensors(path, [(n, CONTAINED.get(n, "F32"), sizes[n]) for n in names], reduce(DataFrame.unionByName, parts))


def _written(spark: SparkSession, sf_dir: str, shards: int = 1) -> tuple[str, str]:
    """The container of the tables, one file or an index of several, and what the quantize command makes of it."""
    folder, names = _folder(spark), [*CONTAINED, tables.MATRIX]
    source, output = f"{folder}/in.safetensors", f"{folder}/out.safetensors"
    if shards == 1:
        container(spark, sf_dir, source, names)
    else:
        files = {f"in-{k}.safetensors": names[k::shards] for k in range(shards)}
        for file, own in files.items():
            container(spark, sf_dir, f"{folder}/{file}", own)
        source += ".index.json"
        with open(source, "x", encoding="utf-8") as f:
            json.dump({"weight_map": {n: file for file, own in files.items() for n in own}}, f)
    model.quantize(spark, source, output)
    return source, output


def _read_back(spark: SparkSession, output: str) -> DataFrame:
    """Where each tensor of a quantized container lies, and a sum over what is read back of it."""
    found = safetensors.catalog(spark, output)
    codes = [r.tensor for r in found.filter("dtype = 'I8'").collect()]
    total = lambda df, x: df.groupBy("tensor").agg(F.sum(x).cast("bigint").alias("total"))
    sums = total(safetensors.codes(spark, output, codes).select("tensor", F.explode("qs").alias("q")), F.col("q"))
    floats = safetensors.chunks(spark, output).select("tensor", F.explode("vals").alias("v"))
    sums = sums.unionByName(total(floats, diagnostics.scaled(F.col("v").cast("double"), 1e6)))
    whole = safetensors.integers(spark, output, [r.tensor for r in found.filter("dtype = 'I32'").collect()])
    sums = sums.unionByName(total(whole.select("tensor", F.explode("vals").alias("v")), F.col("v")))
    return found.join(sums, "tensor").select("tensor", "dtype", "byte_len", "data_start", "data_end", "total")


@query
def safetensors_write_read(spark, sf_dir):
    return _read_back(spark, _written(spark, sf_dir)[1])


@query
def sharded_write_read(spark, sf_dir):
    """The same from three shards under an index."""
    return _read_back(spark, _written(spark, sf_dir, 3)[1])


@query
def preserved_bytes_check(spark, sf_dir):
    """Tensors that the quantize command kept: their bytes in the source and in the output."""
    source, output = _written(spark, sf_dir)
    names = [r.tensor for r in safetensors.catalog(spark, output).collect() if not r.tensor.endswith((".qdata", ".scale"))]
    read = lambda path, to: safetensors.payload(spark, path, tensors=names).select("tensor", "chunk", F.col("bytes").alias(to))
    both = read(source, "a").join(read(output, "b"), ["tensor", "chunk"], "full_outer")
    return both.groupBy("tensor").agg(F.sum(F.octet_length("a")).alias("n"), F.bool_and(F.coalesce(F.col("a") == F.col("b"), F.lit(False))).alias("same"))


@query
def gguf_write_read(spark, sf_dir):
    """The embedding matrix written as Q8_0 by executors and read back by the data source."""
    path, m = f"{_folder(spark)}/m.gguf", tables.matrix_chunks(spark, sf_dir)
    count = m.count()
    gguf.write_chunks(path, "m", [count, 64], m)
    rows = gguf.read_blocks(spark, path).select("block", "scale", F.posexplode("qs").alias("i", "q"))
    return q.dequantize(rows).select((F.col("block") * 32 + F.col("i")).alias("idx"), _d("v_hat"))


@query
def manifest_json(spark, sf_dir):
    catalog = tables.catalog(spark, sf_dir)
    actions = {r.tensor: r.action for r in policy.decide(catalog).collect()}
    return spark.createDataFrame([(safetensors.manifest(catalog.orderBy("tensor").collect(), actions, "tensorloom"),)], "manifest string")
