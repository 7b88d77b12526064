"""Driver tables as tensors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quantize import explode_arrays
from ..schema import check_layout

#: Columns that make 1-D tensors, with their table's unique key; None: no unique key, so order-insensitive uses only.
COLUMNS = {
    "lineitem.l_quantity": None, "lineitem.l_extendedprice": None, "lineitem.l_discount": None, "lineitem.l_tax": None,
    "orders.o_totalprice": "o_orderkey", "customer.c_acctbal": "c_custkey", "supplier.s_acctbal": "s_suppkey",
    "part.p_retailprice": "p_partkey", "events.value": "event_id",
}
INTEGERS = {"orders.o_orderkey": "I64", "customer.c_custkey": "I64", "customer.c_nationkey": "I32", "part.p_size": "I32", "nation.n_nationkey": "I32", "region.r_regionkey": "I32"}

MATRIX = "embeddings.embedding"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tensor, idx, v): each embedding is a tensor."""
    return explode_arrays(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def matrix_chunks(spark: SparkSession, sf_dir: str, width: int = 64) -> DataFrame:
    """The matrix of all embeddings as chunks (tensor, base_idx, vals), a row of it each."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.lit("m").alias("tensor"), (F.col("vec_id") * width).cast("bigint").alias("base_idx"), F.col("embedding").cast("array<float>").alias("vals"))


def matrix(spark: SparkSession, sf_dir: str, width: int = 64) -> DataFrame:
    """All embeddings as one matrix in row-major order."""
    return vectors(spark, sf_dir).select(F.lit("m").alias("tensor"), (F.col("tensor") * width + F.col("idx")).alias("idx"), "v")


def columns(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """(tensor, v) of numeric columns cast to float; no order. One scan for each table."""
    by: dict[str, list[str]] = {}
    for n in names:
        by.setdefault(n.split(".")[0], []).append(n)
    parts = [table(spark, sf_dir, t).select(F.explode(F.array(*[F.struct(F.lit(n).alias("tensor"), F.col(n.split(".")[1]).cast("float").alias("v")) for n in own])).alias("x")).select("x.*") for t, own in by.items()]
    return reduce(DataFrame.unionByName, parts)


def values(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """(tensor, v) of any float tensors of the catalog; no order."""
    parts = [columns(spark, sf_dir, own)] if (own := [x for x in names if x != MATRIX]) else []
    if MATRIX in names:
        parts.append(vectors(spark, sf_dir).select(F.lit(MATRIX).alias("tensor"), "v"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "tensor string, v float")


def ordered_column(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(tensor, idx, v) of a column whose table has a dense unique key: idx is the key minus its minimum."""
    key, rows = COLUMNS[name], table(spark, sf_dir, name.split(".")[0])
    first = rows.agg(F.min(key).alias("first"))
    return rows.crossJoin(F.broadcast(first)).select(F.lit(name).alias("tensor"), (F.col(key) - F.col("first")).cast("bigint").alias("idx"), F.col(name.split(".")[1]).cast("float").alias("v"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tensor, dtype, shape, element_count, byte_len) of the numeric columns and the embedding matrix.

    The counts are taken once; what comes back is metadata, a row for each tensor, so the
    relations planned from it need no further scan.
    """
    kinds = dict.fromkeys(COLUMNS, "F32") | INTEGERS
    by: dict[str, list[str]] = {}
    for n in kinds:
        by.setdefault(n.split(".")[0], []).append(n)
    parts = []
    for t, own in by.items():
        counted = table(spark, sf_dir, t).agg(F.count("*").alias("n"))
        parts.append(counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("tensor"), F.lit(kinds[n]).alias("dtype"), F.array("n").alias("shape"), F.col("n").alias("element_count"), (F.col("n") * (8 if kinds[n] == "I64" else 4)).alias("byte_len")) for n in own])).alias("x")).select("x.*"))
    vec = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"), F.max(F.size("embedding")).cast("bigint").alias("w"))
    parts.append(vec.select(F.lit(MATRIX).alias("tensor"), F.lit("F32").alias("dtype"), F.array("n", "w").alias("shape"), (F.col("n") * F.col("w")).alias("element_count"), (F.col("n") * F.col("w") * 4).alias("byte_len")))
    found = reduce(DataFrame.unionByName, parts)
    rows = found.collect()
    for r in rows:
        check_layout(r.dtype, list(r.shape), r.byte_len)
    return spark.createDataFrame(rows, found.schema)
