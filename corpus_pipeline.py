"""A training corpus from raw documents: rules, near copies, repeats, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but
the last return the columns of documents; where a stage changes a text, n_chars follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm import packing, queries, rules, secret_scan, simhash, substring
from tensorloom.llm.components import shuffled
from tensorloom.llm.storage import materialize


def _with_text(docs: DataFrame, rows: DataFrame, text: F.Column) -> DataFrame:
    """The columns of docs from rows (a struct row of them) with a text put in."""
    put = {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*[put.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def _judged(docs: DataFrame, verdicts: DataFrame, how: str) -> DataFrame:
    """Rows of docs whose id and text hash are (left_semi) or aren't (left_anti) among verdicts (doc_id, text_hash).

    There is up to a verdict a document, so they meet the rows by shuffle, never through the driver.
    """
    d, v = docs.alias("d"), verdicts.select(F.col("doc_id").alias("verdict_id"), F.col("text_hash").alias("verdict_hash")).alias("v")
    same = F.col("d.doc_id").eqNullSafe(F.col("v.verdict_id")) & (F.xxhash64(F.col("d.text")) == F.col("v.verdict_hash"))
    return d.join(shuffled(v), same, how)


def _own(docs: DataFrame) -> DataFrame:
    """What decides: id, text and the text's hash, without the other columns."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or the learned decision list rejects go.

    Only ids, counts and text hashes are written; rows meet their verdict by id and hash, so
    rows that share an id, or have none, are judged each by itself. Null and empty texts
    have too few words and go; rows that repeat stay or go together. Other columns may have
    any names. An empty table gives an empty result.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    found = rules.apply_rules(_own(docs), labels, carry=["text_hash"])
    return _judged(docs, found.filter("not kept").select("doc_id", "row.text_hash"), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the smallest id, of its texts the one with the smallest hash.

    Rows are judged by id and text hash, so rows that share an id, or have none, stay or go
    each by itself; a row without an id stays where its component has no other. Null and
    word-less texts are one component. Rows that repeat an id and its text count once, with
    the smallest of their other columns, which may have any names. An empty table gives an
    empty result.
    """
    found = simhash.clusters(_own(docs), carry=("text_hash",))
    texts = found.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n")
    first = materialize(texts.groupBy("root").agg(F.min(order).alias("x")).select("x.doc_id", "x.text_hash", "x.n"), "near")
    stay = _judged(docs, first, "left_semi")
    if first.filter("n > 1").isEmpty():
        return stay
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    if not rest:
        return stay.distinct()
    once = stay.groupBy("doc_id", "text").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("rest"))
    return once.select(*[F.col(c if c not in rest else f"rest.`{c}`").alias(c) for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has are cut; texts without any stay as they are.

    Every row stays, with the other columns, which may have any names: the text is dealt
    once and the row carries them. Null texts stay null; rows of one id, or without any, cut
    nothing from one another; of equal passages the smallest id keeps its own. An empty
    table gives an empty result.
    """
    out = substring.remove_repeats(docs, keep_text=True, carry=[c for c in docs.columns if c != "text"])
    return _with_text(docs, out, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("t")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; texts without any stay as they are.

    Every row stays, with the other columns, which may have any names; null texts stay null;
    spans that overlap become one mark; rows that repeat are scanned each by itself. An
    empty table gives an empty result.
    """
    out = secret_scan.find_secrets(docs, keep_text=True, carry=docs.columns)
    return _with_text(docs, out, F.when(F.col("row.text").isNotNull(), secret_scan.masked(F.col("t"), F.col("spans"))))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of up to 4096 tokens, a row for each piece of a document.

    Null and empty texts hold the end id alone; rows of one id, or without any, are packed
    each by itself; other columns are left out. An empty table gives an empty result.
    """
    return packing.pack(docs, queries.tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("secret scans", secrets),
    ("packing", packed),
]

#: Learned rules, components and token ids can't be expressed in SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written as Parquet in the shared folder and read again.

    Nulls, repeated rows and odd texts as in the stages; an empty documents table gives an
    empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
