"""inspect, quantize and validate for SafeTensors files."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as n
from ..operators import blocks, diagnostics, layout, policy, validate
from ..schema import CHUNK_ELEMENTS, INT8_MAX, MINIMUM_ELEMENTS, TensorError
from ..sources import safetensors as st


def exponent(x: float, digits: int = 3) -> str:
    """1.234e-5: no plus sign, no padding in the exponent."""
    mantissa, e = f"{x:.{digits}e}".split("e")
    return f"{mantissa}e{int(e)}"


def inspect(path: str) -> str:
    h = st.open_input(path)
    rows = [f"  {t.name} | dtype={t.dtype} | shape=[{', '.join(map(str, t.shape))}] | bytes={t.byte_len}" for t in h.tensors]
    return "\n".join(["Format: SafeTensors", f"File size: {h.file_size} bytes", *([f"Shards: {len(h.files)}"] if len(h.files) > 1 else []), f"Tensors: {len(h.tensors)}", *rows])


@dataclass
class Plan:
    """The relations of a quantization before anything is written."""

    source: str
    catalog: DataFrame
    decisions: DataFrame
    layout: DataFrame
    scales: DataFrame
    quantized: DataFrame  # tensor, chunk, qs
    diagnostics: DataFrame


def plan(spark: SparkSession, source: str, minimum: int = MINIMUM_ELEMENTS, chunk: int = CHUNK_ELEMENTS) -> Plan:
    """Everything but the write. Chunks stay arrays: scales are a small aggregate, nothing else shuffles."""
    catalog = st.catalog(spark, source)
    decisions = _held(policy.decide(catalog, minimum))
    names = [r.tensor for r in decisions.collect() if r.action == "quantize"]
    chunks = st.chunks(spark, source, chunk, tensors=names)
    scales = blocks.tops(chunks).select("tensor", n.symmetric_scale(F.col("amax"), INT8_MAX).alias("scale"))
    quantized = chunks.join(scales, "tensor").select("tensor", "chunk", "base_idx", "scale", "vals", F.transform("vals", lambda v: n.quantize(v, F.col("scale"), INT8_MAX)).alias("qs"))
    sized = diagnostics.tensor_diagnostics(_pairs(quantized), INT8_MAX).drop("source_bytes", "compression_ratio").join(catalog.select("tensor", F.col("byte_len").alias("source_bytes")), "tensor")
    found = sized.withColumn("compression_ratio", diagnostics.ratio(F.col("source_bytes"), F.col("quantized_bytes"))).join(scales, "tensor")
    return Plan(source, catalog, decisions, _held(layout.plan(catalog, decisions)), scales, quantized, _held(found))


def _held(rows: DataFrame) -> DataFrame:
    """Metadata, a row a tensor or an output, planned once: the report and the checks need no further scan."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def _pairs(rows: DataFrame) -> DataFrame:
    """(tensor, idx, v, q, v_hat) of chunks with base_idx, scale, vals and qs."""
    zipped = rows.select("tensor", "base_idx", "scale", F.posexplode(F.arrays_zip("vals", "qs")).alias("i", "x"))
    return zipped.select("tensor", (F.col("base_idx") + F.col("i")).alias("idx"), F.col("x.vals").alias("v"), F.col("x.qs").alias("q"), n.dequantize(F.col("x.qs"), F.col("scale")).alias("v_hat"))


def progress(p: Plan) -> list[str]:
    """A line for each tensor in name order."""
    rows = p.decisions.select("tensor", "action", "reason_text").join(p.diagnostics.select("tensor", "mse", "mae", "scale"), "tensor", "left").orderBy("tensor").collect()
    out = []
    for i, r in enumerate(rows, 1):
        what = f"preserve ({r.reason_text})" if r.action == "preserve" else f"quantize | mse={exponent(r.mse)} | mae={exponent(r.mae)} | scale={exponent(r.scale, 6)}"
        out.append(f"Progress: {i}/{len(rows)} | {r.tensor} | {what}")
    return out


def _met(spark: SparkSession, p: Plan, output: str, chunk: int) -> DataFrame:
    """The source's chunks with the output's codes of them, by (tensor, chunk); LengthMismatch where either lacks some."""
    names = {r.name: r.source_name for r in p.layout.filter("role = 'qdata'").select("name", "source_name").collect()}
    of = spark.createDataFrame(list(names.items()), "tensor string, source_name string")
    codes = st.codes(spark, output, list(names), chunk).join(of, "tensor").select(F.col("source_name").alias("tensor"), "chunk", "qs")
    both = st.chunks(spark, p.source, chunk, tensors=list(names.values())).join(codes, ["tensor", "chunk"], "full_outer")
    odd = both.filter("vals is null or qs is null or size(vals) <> size(qs)").select("tensor", "chunk").limit(1).collect()
    if odd:
        raise TensorError("LengthMismatch", f"tensor {odd[0].tensor} in chunk {odd[0].chunk}")
    return both


def reopened(spark: SparkSession, p: Plan, output: str, scales: DataFrame, chunk: int = CHUNK_ELEMENTS) -> DataFrame:
    """Diagnostics by tensor of what the output's own qdata and scales (tensor, scale) dequantize to, against the source."""
    rows = _pairs(_met(spark, p, output, chunk).join(scales, "tensor"))
    validate.check(validate.out_of_range(rows, -INT8_MAX, INT8_MAX), validate.overflows(rows))
    return diagnostics.tensor_diagnostics(rows, INT8_MAX)


def output_scales(spark: SparkSession, p: Plan, output: str) -> DataFrame:
    """(tensor, scale) of the output's scale tensors, by the name of their source."""
    rows = p.layout.filter("role = 'scale'").select(F.col("name").alias("tensor"), "source_name").collect()
    read = st.chunks(spark, output, tensors=[r.tensor for r in rows])
    return read.join(spark.createDataFrame(rows, "tensor string, source_name string"), "tensor").select(F.col("source_name").alias("tensor"), F.get("vals", 0).alias("scale"))


def check_codes(spark: SparkSession, p: Plan, output: str, chunk: int = CHUNK_ELEMENTS) -> None:
    """The output's scales and codes must be just those that the source quantizes to; a single wrong byte raises."""
    scales = output_scales(spark, p, output)
    wrong = scales.join(p.scales.select("tensor", F.col("scale").alias("want")), "tensor", "full_outer").filter("scale is null or want is null or scale <> want")
    places = F.transform("vals", lambda v, i: n.quantize(v, F.col("want"), INT8_MAX) != F.get("qs", i))
    codes = _met(spark, p, output, chunk).join(p.scales.select("tensor", F.col("scale").alias("want")), "tensor").select("tensor", "base_idx", F.array_position(places, True).alias("at")).filter("at > 0")
    row = lambda df, code, idx: df.select("tensor", F.lit(code).alias("code"), idx.cast("bigint").alias("idx"), F.lit(1).cast("bigint").alias("n"))
    validate.check(row(wrong, "ScaleDiffers", F.lit(0)), row(codes, "QuantizedValueDiffers", F.col("base_idx") + F.col("at") - 1))


def check_output(spark: SparkSession, p: Plan, output: str) -> dict:
    """Reopen the output: names, preserved bytes, scales, dequantized values and their metrics."""
    planned, made = p.layout.select("name", "source_name", "role", "byte_len"), st.read_header(output)
    actual = st.catalog(spark, output)
    if not layout.same_names(planned, actual.select(F.col("tensor").alias("name"))):
        raise TensorError("PlanMismatch", "the output's tensors are not the planned ones")
    digest = lambda df: df.groupBy("tensor").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", F.sha2("bytes", 256).alias("h")))), lambda x: x["h"]), ","), 256).alias("h"))
    kept = planned.filter("role = 'preserved'").select(F.col("name").alias("tensor"))
    names = [r.tensor for r in kept.collect()]
    before, after = (digest(st.payload(spark, f, tensors=names)) for f in (p.source, output))
    if not before.join(after, ["tensor", "h"], "left_anti").isEmpty():
        raise TensorError("PreservedBytesDiffer", output)
    scales = output_scales(spark, p, output)
    validate.check(validate.bad_scales(scales))
    counts = {x.role: x["count"] for x in planned.groupBy("role").count().collect()}
    if counts.get("scale", 0) != counts.get("qdata", 0) or scales.count() != counts.get("scale", 0):
        raise TensorError("MissingScale", output)
    r = diagnostics.model_report(reopened(spark, p, output, scales)).first()
    if r.quantized_tensors != counts.get("qdata", 0):
        raise TensorError("LengthMismatch", output)
    return r.asDict() | {"quantized_tensors": counts.get("qdata", 0), "preserved_tensors": counts.get("preserved", 0), "output_bytes": made.file_size}


def quantize(spark: SparkSession, source: str, output: str, output_format: str = "int8", device: str = "cpu", minimum: int = MINIMUM_ELEMENTS, namespace: str = "tensorloom") -> list[str]:
    """Write output and return the report's lines; nothing stays behind if a step fails."""
    policy.check_options(output_format, device)
    p = plan(spark, source, minimum)
    lines = progress(p)
    st.write(source, output, p.layout, p.decisions, p.quantized, p.scales, layout.plan(p.catalog, p.decisions), namespace)
    try:
        r = check_output(spark, p, output)
        check_codes(spark, p, output)
    except Exception:
        os.remove(output)
        raise
    return [*lines, "", "Final report:", f"  Source: {source}", f"  Output: {output}", *summary(source, r)]


def validated(spark: SparkSession, source: str, output: str, minimum: int = MINIMUM_ELEMENTS) -> list[str]:
    """Check an output that was written before against its source; the report's lines."""
    p = plan(spark, source, minimum)
    r = check_output(spark, p, output)
    check_codes(spark, p, output)
    return [f"Source: {source}", f"Output: {output}", *summary(source, r)]


def summary(source: str, r: dict) -> list[str]:
    before, after = st.open_input(source).file_size, r["output_bytes"]
    size = f"smaller by {before - after}" if after < before else f"larger by {after - before}"
    sqnr = "undefined" if r["lowest_sqnr_db"] is None else f"{r['lowest_sqnr_db']:.2f} dB"
    return [
        f"  Tensors: {r['quantized_tensors']} quantized, {r['preserved_tensors']} preserved",
        f"  Source bytes: {before}",
        f"  Output bytes: {after}",
        f"  Size: {size} bytes",
        f"  Validation: passed (reopened and dequantized {r['quantized_tensors']} quantized tensors)",
        f"  Max MSE: {exponent(r['max_mse'])}",
        f"  Max MAE: {exponent(r['max_mae'])}",
        f"  Max absolute error: {exponent(r['max_abs_error'])}",
        f"  Saturated INT8 values: {r['saturated_values']}",
        f"  Lowest SQNR: {sqnr}",
    ]
