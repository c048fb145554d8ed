"""Session defaults and the one way lineage is cut."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("twinraster")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Holds the folder that a local session without a configured one takes; only settings outside spark.* can be set on a running session.
_LOCAL_FOLDER = "twinraster.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for intermediate data. Only a local session, as in tests, may go without: it takes one folder of its own."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if not spark.conf.get(_LOCAL_FOLDER, None):
        spark.conf.set(_LOCAL_FOLDER, tempfile.mkdtemp(prefix="spark-"))
    return spark.conf.get(_LOCAL_FOLDER)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder for a table written between two steps."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
