"""Writing intermediate tables once, in the folder the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


BUCKETED = "panelcast_bucketed_"  # how the names of bucketed tables begin in the session's catalog


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share.

    Where none is configured a temporary folder is made in local mode; on a cluster that would
    scatter files over the machines, so it is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="panelcast-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """Where this application writes its intermediate tables."""
    return f"{shared_folder(spark)}/panelcast/{spark.sparkContext.applicationId}"


def remove_run_folder(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, once its results are stored elsewhere."""
    for found in spark.catalog.listTables(pattern=f"{BUCKETED}*"):
        spark.sql(f"DROP TABLE IF EXISTS `{found.name}`")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None, buckets: tuple[int, str] | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage: lost executors re-read files instead of recomputing the chain,
    and later readers get column pruning and filter pushdown. With buckets (number, key) it is an external table of the
    session's catalog, the only place that remembers buckets, with its files in the same folder.
    """
    unique = uuid.uuid4().hex
    path = f"{run_folder(df.sparkSession)}/{name}-{unique}"
    if buckets:
        table = f"{BUCKETED}{name}_{unique}"
        df.write.mode("errorifexists").format("parquet").bucketBy(*buckets).option("path", path).saveAsTable(table)
        return df.sparkSession.table(table)
    df.write.mode("errorifexists").parquet(path, partitionBy=partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """Hint a broadcast only after counting; larger tables are left to a shuffled join."""
    few = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else df
