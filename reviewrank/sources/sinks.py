"""Tables and files this engine writes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewrank.session import shared_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _dead_lines(rejected: DataFrame) -> DataFrame:
    doubles = {n for n, t in rejected.dtypes if t == "double"}
    cols = [F.nanvl(c, F.lit(None)).alias(c) if c in doubles else F.col(c) for c in rejected.columns]
    line = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    return rejected.select(line.alias("value"))


def write_dead_letter(rejected: DataFrame, path: str) -> None:
    """Append rejects with their reason as JSON lines; unknown numbers become null."""
    _dead_lines(rejected).write.mode("append").text(path)


def write_dead_letter_batch(rejected: DataFrame, path: str) -> None:
    """The rejects of one micro-batch; running the batch again replaces them."""
    _dead_lines(rejected).write.mode("overwrite").text(path)


def write_event_store(valid: DataFrame, path: str, files: int | None = None) -> None:
    """Flat events as zstd Parquet, ranged and sorted by session so that one session touches few files."""
    n = files or int(valid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = valid.repartitionByRange(n, "session_id", "ts_ms").sortWithinPartitions("session_id", "ts_ms")
    ranged.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def write_store_table(df: DataFrame, path: str) -> None:
    """One feature-store table (features, temporal or flags)."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def write_assessments(assessments: DataFrame, path: str) -> None:
    assessments.write.mode("errorifexists").json(path)
