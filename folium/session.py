"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark alone, so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_methods(spark: SparkSession) -> None:
    """Lets stages whose generated methods are over 8000 bytes run expression by expression.

    The JVM never compiles such methods and interprets them, at about half the speed. Results do not change; the setting holds
    for the session, and one of the caller's own stays.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key) == "65535":
        spark.conf.set(key, "8000")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for cut lineage: spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found:
        return found
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="folium-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written to a table in the shared folder and read again, kept when executors go.

    Unlike a checkpoint, the table is computed once and brings its own size; the sizes that a checkpoint inherits are products
    over all joins before it, and in a loop they grow until planning takes longer than running.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by cut() that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
