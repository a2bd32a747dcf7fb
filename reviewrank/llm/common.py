"""Helpers shared by the text operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

TEXT_BATCH_BYTES = 8 * 1024 * 1024
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_HELD: dict = {}


def held_by_worker(key: tuple | None = None, make: Callable[[], object] | None = None):
    """What a Python worker keeps between tasks: the tables and caches of one operator at a time.

    Another ``key`` frees what was held and is made anew; none only frees.
    """
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if key is not None:
            _HELD[key] = make()
    return _HELD.get(key)


def bound_arrow(spark: SparkSession, limit: int = TEXT_BATCH_BYTES) -> None:
    """Let the session hand Python at most ``limit`` bytes a batch: ten thousand long texts are too many for both sides."""
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(ARROW_BYTES))
    spark.conf.set(ARROW_BYTES, str(min(limit, now)))


def bounded_batches(batches: Iterator[pa.RecordBatch], limit: int = TEXT_BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Halve batches until each holds at most ``limit`` bytes or one row, so long texts never pile up as Python objects."""
    for batch in batches:
        todo = [batch]
        while todo:
            b = todo.pop()
            if b.num_rows > 1 and b.nbytes > limit:
                half = b.num_rows // 2
                todo += [b.slice(half), b.slice(0, half)]
            elif b.num_rows:
                yield b


def map_rows(df: DataFrame, ddl: str, rows_of: Callable[[], Callable[[dict], list[tuple]]]) -> DataFrame:
    """Arrow batches in, rows out.

    ``rows_of()`` runs once per task and returns a function from a batch (column name -> Python list) to rows of
    ``ddl``.  One batch in gives one batch out, so memory is bounded by :data:`TEXT_BATCH_BYTES` plus one row.
    """
    schema = T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = rows_of()
        for b in bounded_batches(batches):
            rows = each(b.to_pydict())
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, keep_of: Callable[[], Callable[[list[str | None]], list[bool]]]) -> DataFrame:
    """The rows of ``df``, with all columns, whose ``text`` the function made by ``keep_of()`` (once per task) keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = keep_of()
        for b in bounded_batches(batches):
            yield b.filter(pa.array(keep(b.column(b.schema.get_field_index("text")).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of ``df`` (whatever they are called) cannot clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])
