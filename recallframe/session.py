"""Session set-up and the few physical-plan helpers that every operator shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "recallframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; settings given in ``conf`` win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    own = tempfile.mkdtemp(prefix="recallframe-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage through the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def splits(df: DataFrame) -> int:
    """About how many tasks ``df`` comes in, from the plan's size alone; nothing is run for it."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return size // most if size < 1 << 60 else df.rdd.getNumPartitions()  # no size known: a table without lineage


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """Give a Python stage enough tasks.

    Large inputs already come in more splits than there are cores and pass
    unshuffled; only an input of few splits is dealt out again.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if splits(df) >= 2 * cores else df.repartition(per_core * cores)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{checkpoint_dir(spark)}/{kind}/{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)  # only what exists can be marked for deletion
    files.deleteOnExit(place)
    return path


def written(df: DataFrame) -> DataFrame:
    """Like ``cut``, but as a columnar table in the shared folder: smaller, and read by column."""
    spark = df.sparkSession
    path = f"{shared_path(spark, 'tables')}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
