"""Watching heads: a file stream of head manifests indexes what changed, once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import branch_from_ref
from graphloom.sources.config import to_index

HEADS = "repo_id string, branch string, sha string"
HOOKS = "repository string, ref string, after string"


def head_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(HEADS).json(path)


def hook_stream(spark: SparkSession, path: str) -> DataFrame:
    """Push events as heads; other refs than branches are dropped."""
    hooks = spark.readStream.schema(HOOKS).json(path)
    return hooks.select(F.col("repository").alias("repo_id"), branch_from_ref(F.col("ref")).alias("branch"), F.col("after").alias("sha")).where("branch is not null")


def watch(heads: DataFrame, state_path: str, checkpoint: str, index: Callable[[DataFrame], None], trigger: dict | None = None):
    """Call ``index`` with the heads of each batch that differ from the stored state, then store them.

    The state is a table with one row for each indexed (repo_id, branch, sha, batch); the latest batch counts. A batch
    that is run again finds its heads stored and indexes nothing.
    """
    spark = heads.sparkSession

    def state() -> DataFrame:
        try:
            s = spark.read.parquet(state_path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], "repo_id string, branch string, indexed_sha string")
        return s.groupBy("repo_id", "branch").agg(F.max_by("sha", "batch").alias("indexed_sha"))

    def each(batch: DataFrame, number: int) -> None:
        new = to_index(batch.dropDuplicates(["repo_id", "branch", "sha"]), state()).persist()
        if not new.isEmpty():
            index(new)
            new.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(state_path)
        new.unpersist()

    return heads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
