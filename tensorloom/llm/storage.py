"""Tables in the folder that every executor shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or else the checkpoint folder set in this context.

    Where neither is set a local master (tests) gets a temporary folder of its own, set as
    its checkpoint folder and removed when the process ends. A cluster gets an error: a
    folder of one machine would lose the tables.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tensorloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(f"file://{own}")
    return sc.getCheckpointDir()


def tables_dir(spark: SparkSession) -> str:
    """Where this application's tables lie."""
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the stages before.
    Every call writes to a folder of its own, so a rerun never meets an older table.
    """
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Remove this application's tables; results that were not written yet need them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
