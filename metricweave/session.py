"""Session settings and shared scratch space."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

# what scratch_path makes: a label and a random number
SCRATCH_NAME = re.compile(r"[\w.]+-[0-9a-f]{32}")


def build_session(app: str = "metricweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on.

    UTC keeps epoch arithmetic and calendar truncation in step; adaptive
    execution re-plans joins at run time and splits skewed partitions. Sizes
    (memory, shuffle partitions) belong to the cluster and come from its own
    configuration or from ``conf``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or one in the warehouse.

    The warehouse is shared wherever tables can be written, so it stands in where no
    checkpoint folder is named. A warehouse on the machine's own disk is shared with
    executors in the driver's process only; on a cluster it is refused, since each
    executor would write where no other one reads.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return folder_for(warehouse, spark.sparkContext.master, spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///"))


def folder_for(warehouse: str, master: str, default_store: str) -> str:
    """The scratch folder of a warehouse, if executors under ``master`` share it."""
    scheme = warehouse.partition(":")[0] if re.match(r"[a-zA-Z][\w+.-]*:", warehouse) else default_store.partition(":")[0]
    if scheme == "file" and not re.fullmatch(r"local(\[[^]]*\])?", master):
        raise ValueError(f"executors do not share {warehouse}: set spark.checkpoint.dir to a folder of a common store")
    return f"{warehouse}/_scratch"


def drop_scratch(df: DataFrame) -> None:
    """Delete the stored tables that ``df`` reads, once its result has been written."""
    context, spark = df.sparkSession.sparkContext, df.sparkSession
    shared = f"{shared_dir(spark).rstrip('/')}/"
    path_of = context._jvm.org.apache.hadoop.fs.Path
    root = path_of(shared).toUri().getPath().rstrip("/") + "/"
    for file in df.inputFiles():
        folder = path_of(file).getParent()
        inner = folder.toUri().getPath()
        if inner.startswith(root) and SCRATCH_NAME.fullmatch(inner[len(root):]):
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, for a table written and read back."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there.

    For results that several jobs read: they are computed once, later readers
    prune columns, and a lost executor costs a re-read instead of a re-run.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
