"""Tables stored in the shared checkpoint folder, so that iterative jobs survive the loss of executors."""

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_stored: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. On one machine alone a temporary one may take its place."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """The path of a folder in the shared checkpoint folder, deleted at the end of the process."""
    path = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    if not _stored:
        atexit.register(release)
    _stored.append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """`df` written as a table in the shared checkpoint folder and read back, so that later reads take only some columns."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Deletes all stored tables of this process; results that were made from them must have been read before."""
    spark = SparkSession.getActiveSession()
    while spark is not None and _stored:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_stored.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
