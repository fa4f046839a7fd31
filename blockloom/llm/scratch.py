"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Writers hold a row group of each task in memory.
ROW_GROUP = 16 << 20
#: Texts go to Python so many rows at a time, where the session does not say otherwise: JVM and
#: worker hold a batch each, beside the heap.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
#: Spark takes one buffer of this size, by default 4 MB, for every scan and every stage, whose few
#: KB it broadcasts: hundreds in a query of many steps, each too large for the heap's young part.
PIECE, PIECE_SIZE = "spark.broadcast.blockSize", "256k"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which a session on a cluster must set.

    In local mode, where driver and executors are one process, a temporary folder serves where
    it is unset, until the process ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="blockloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        named = "file://" + folder
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def free_name(name: str, columns: list[str]) -> str:
    """The name, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Folders of this process, without any table, whose plans would stay in the driver.
_ROOTS: list[str] = []


@atexit.register
def _clean() -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        spark = SparkSession.getActiveSession()
        while spark and _ROOTS:
            _delete(spark, _ROOTS.pop())


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_pieces(spark: SparkSession) -> None:
    """Broadcasts in small pieces, where the application does not say otherwise; results are the same."""
    with contextlib.suppress(Exception):  # a Spark that does not let us costs memory and nothing else
        conf = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().conf()
        if not conf.contains(PIECE):
            conf.set(PIECE, PIECE_SIZE)


class Scratch:
    """Tables written once and read back, which cuts lineage and survives a lost executor.

    Operators drop the tables that nothing reads any more; those that a result reads stay until
    the process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/blockloom-{uuid.uuid4().hex}"
        self.count = 0
        _ROOTS.append(self.root)
        if spark.conf.get(BATCH) == "10000":  # Spark's own
            spark.conf.set(BATCH, str(BATCH_ROWS))
        small_pieces(spark)

    def save(self, df: DataFrame, *by: str) -> DataFrame:
        """The table as written, in a folder for each value of the columns ``by``."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        # No mark of success: nothing reads it, and on a local disk it starts a process.
        writer = df.write.option("parquet.block.size", ROW_GROUP).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
        writer.partitionBy(*by).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame, part: str = "") -> None:
        """Deletes tables that :meth:`save` returned, or one folder of them; nothing may read them any more."""
        for table in tables:
            _delete(self.spark, f"{table.scratch_path}/{part}".rstrip("/"))
