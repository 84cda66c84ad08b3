"""Session settings and staged tables in the shared folder.

Iterative operators cut their lineage by writing a table and reading it again.  The folder is the one the
cluster names in ``spark.checkpoint.dir``; only where that is unset (tests, a laptop) is a temporary one
made.  A written table survives the loss of any executor, which a local checkpoint does not.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", app: str = "partweave", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables: ``spark.checkpoint.dir`` of the session, else the checkpoint
    directory set on its context, else (only where neither is set, and only on a local master) a new temporary folder,
    which is then remembered in the session.  On a cluster a folder of one machine would be lost with it, so there the
    setting is demanded."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    option = spark.sparkContext._jsc.sc().getCheckpointDir()
    if option.isDefined():
        return option.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="partweave-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for a costly step that reads it row by row.

    ``df`` must be a scan with projections and filters, whose partitions are known without running it.  Only a table that comes in fewer pieces is shuffled: it then fits in a few splits, so little is moved; a large
    table is left where it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


class Workspace:
    """Staged tables of one run of one operator, removed one by one or when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path)
        self._fs.deleteOnExit(self._path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads what was written."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """As save, with the number of rows, counted while they are written."""
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        saved = self.save(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
        return saved, seen.get["n"]

    def drop(self, name: str) -> None:
        """Remove a staged table that nothing reads any more."""
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)
