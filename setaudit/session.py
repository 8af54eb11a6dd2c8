"""Session factory and the helpers that every operator shares."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str = "local[*]", app: str = "setaudit", **conf: str) -> SparkSession:
    """A session with the settings this library is tested with; on a cluster pass the cluster's own session instead."""
    builder = SparkSession.builder.master(master).appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(max(8, os.cpu_count() or 8)),
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` where it is set. Where it is not, a temporary folder serves a
    session in local mode, as in tests; on a cluster, whose executors could not read it, that is an error."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="setaudit-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared checkpoint folder, so a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unsized(df: DataFrame) -> DataFrame:
    """The same rows without the estimate of their size.

    A checkpoint keeps the estimate of its plan; in a loop of joins that multiplies from round to round until it overflows.
    """
    return type(df)(df.sparkSession._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), df.sparkSession)


def spread(df: DataFrame) -> DataFrame:
    """The same rows in at least as many partitions as the cluster has cores.

    For work that is heavy per row over a table that arrives in few splits; a table of enough splits is not shuffled. Only
    a plan without a shuffle is asked for its splits, which plans but runs nothing; after a shuffle the engine has chosen.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.sparkPlan().toString() or "Exchange" in plan.executedPlan().toString():
        return df
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df


def with_settings(df: DataFrame, settings: dict[str, str]) -> DataFrame:
    """The same rows in a copy of their session that has these settings; the caller's session keeps its own."""
    session = df.sparkSession._jsparkSession.cloneSession()
    for key, value in settings.items():
        session.conf().set(key, value)
    spark = SparkSession(df.sparkSession.sparkContext, session)
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, df._jdf.queryExecution().logical()), spark)
