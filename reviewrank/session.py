"""Spark session for local work, and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def local_session(cpus: str = "8", memory: str = "12g") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("reviewrank")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE_PARTITIONS", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine gets a fresh local folder; on a cluster executors would not see each
    other's files there, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if named is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="reviewrank-"))
        current = spark.sparkContext.getCheckpointDir()
    return named or current


METHOD_BYTES = "spark.sql.codegen.hugeMethodLimit"


def compiled_methods(spark: SparkSession, limit: int = 8000) -> None:
    """Let no step generate a method longer than the JVM compiles: such a step would run interpreted, on every row."""
    spark.conf.set(METHOD_BYTES, str(min(limit, int(spark.conf.get(METHOD_BYTES)))))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later stages then start from files that outlive lost executors, and whose size the planner knows.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that cut lineage like :func:`cut_lineage` and go once nothing reads them any more.

    A table may be dropped as soon as every table made from it is written: recovery then starts from those files.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._paths = spark, {}

    def cut(self, df: DataFrame, *replaced: DataFrame) -> DataFrame:
        """Write ``df`` and read it back, then drop the tables it replaces."""
        path = f"{shared_dir(self.spark)}/cut-{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (out, path)
        self.drop(*replaced)
        return out

    def drop_all(self) -> None:
        """Remove all tables that are left."""
        self.drop(*[table for table, _ in self._paths.values()])

    def tidy(self) -> None:
        """Free the shuffle files of finished jobs now: Spark removes them once the driver's JVM has collected their plans."""
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Remove the files of tables made here; others are left alone."""
        for table in tables:
            _, path = self._paths.pop(id(table), (None, None))
            if path is not None:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def small_table(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A fixed lookup table held in the plan itself (no job, no Python worker)."""
    schema = StructType.fromDDL(ddl)
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=to_arrow_schema(schema)), schema)
