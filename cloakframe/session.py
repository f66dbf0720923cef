"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "cloakframe", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested with."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE_PARTITIONS", "8"))
        .config("spark.driver.memory", os.environ.get("DRIVER_MEMORY", "8g"))
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


#: Of a scan's bytes that one core reads; a table with fewer for each core is small.
CORE_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores if it is so small that its scan would leave most of them idle, else as it is.

    A small file is often one row group, which one task reads. Tables that fill the cluster are never shuffled here, nor
    streams, nor what is more than a scan with projections and filters.
    """
    if df.isStreaming:
        return df
    plan = df._jdf.queryExecution().optimizedPlan()
    nodes = {line.lstrip("+-: ").split(" ")[0] for line in plan.toString().splitlines() if line.strip()}
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not nodes <= {"Project", "Filter", "Relation"} or int(str(plan.stats().sizeInBytes())) >= cores * CORE_BYTES or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(2 * cores)
