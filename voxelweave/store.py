"""Tables that are written once and read by many queries, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_KNOWN: dict[tuple, str] = {}
_SCHEMAS: dict[str, StructType] = {}


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of this machine only where none is set and the master is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def written(df: DataFrame) -> DataFrame:
    """The rows of df from a Parquet table, which a lost executor doesn't take along."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, name: tuple, make: Callable[[str], object]) -> str:
    """The path of what make(path) writes, made once for each application and name."""
    key = (spark.sparkContext.applicationId, *name)
    if key not in _KNOWN or not there(spark, _KNOWN[key]):
        path = f"{folder(spark)}/{name[0]}-{uuid.uuid4().hex}"
        make(path)
        _KNOWN[key] = path
    return _KNOWN[key]


def table_once(spark: SparkSession, name: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """The rows of build() from a table that is written once for each application and name, read without looking up its schema."""
    def make(path: str) -> None:
        df = build()
        df.write.parquet(path)
        _SCHEMAS[path] = df.schema

    path = once(spark, name, make)
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose schema is looked up, which takes a job, once only in this process."""
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """What Spark's optimizer takes for the size of df: no job is run, and of a table's filters the whole table is the bound."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
