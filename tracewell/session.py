"""Sessions and tables written in the folder that a cluster's nodes share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "tracewell", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` adds or overrides settings (dots as double underscores)."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all is one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        found = tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it is computed once, and a lost executor loses no part of it. ``discard`` takes it away again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder below the shared one, in whatever file system that is."""
    if not path.startswith(f"{shared_dir(spark)}/tables/"):
        raise ValueError(f"{path} is not a table of the shared folder")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``written`` made, once nothing reads them any more; other tables are left alone."""
    for table in tables:
        if path := _paths.pop(table, None):
            delete(table.sparkSession, path)
