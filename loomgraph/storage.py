"""Where operators cut lineage: tables written to the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting for shuffle files that go with the query that wrote them.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a local session gets a temporary one; a cluster, whose
    machines share no such folder, gets an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: later jobs never recompute it, and a lost
    executor costs nothing, because the files are committed. Shuffle files of the write go with its end, for nothing
    reads them again; else they stay on disk until the driver happens to collect its garbage."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files behind a stored() table that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_made: dict[tuple, tuple] = {}


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def once(spark: SparkSession, name: str, source: str, make) -> DataFrame:
    """What make() gives from the tables of a folder, written once in an application and read by whoever asks again; written again if its files
    are gone. The tables are taken not to change meanwhile."""
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _made or not exists(spark, f"{_made[key][0]}/_SUCCESS"):
        df, path = make(), new_path(spark, name)
        df.write.parquet(path)
        _made[key] = (path, df.schema)
    path, schema = _made[key]
    return spark.read.schema(schema).parquet(path)


def replaced(df: DataFrame, path: str, write) -> None:
    """write(df.write, new folder), then that folder takes the place of what is at path by renames: whoever reads finds the old files or the new ones,
    and a failed write leaves the old ones. What stood there goes last."""
    spark, new, old = df.sparkSession, f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    write(df.write, new)
    as_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = as_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = exists(spark, path)
    if had and not files.rename(as_path(path), as_path(old)):
        raise OSError(f"{path} can't be moved away")
    if not files.rename(as_path(new), as_path(path)):
        if had:
            files.rename(as_path(old), as_path(path))
        raise OSError(f"{path} can't be replaced")
    if had:
        files.delete(as_path(old), True)


class Scratch:
    """Stored tables of one computation, deleted together once its result stands by itself."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(stored(df, name))
        return self.tables[-1]

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables, or all."""
        for t in tables or self.tables:
            drop(t)
        self.tables = [t for t in self.tables if tables and not any(t is x for x in tables)]
