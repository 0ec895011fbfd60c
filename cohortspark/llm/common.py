"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows handled at once inside a task; bounds Python memory whatever the Arrow batch holds.
SLICE_ROWS = 256
#: Fan-in of the first level of ``tree_merge``.
TREE_FAN = 256


def column(name: str):
    """A column by its plain name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` (long) and ``text``; other columns go, a null text becomes empty."""
    return df.select(
        column(id_col).cast("long").alias("doc_id"),
        F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"),
    )


def id_and_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``id_and_text`` with the text as UTF-8 bytes."""
    return id_and_text(df, id_col, text_col).withColumn("text", F.col("text").cast("binary"))


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches cut into pieces of at most ``rows`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_slices(
    df: DataFrame, setup: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str
) -> DataFrame:
    """Run a function over small record batches; ``setup`` runs once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup()
        for piece in slices(batches):
            out = work(piece)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, run) -> DataFrame:
    """``mapInArrow`` over all columns under the names ``c0, c1, ...``, whatever theirs are."""
    plain = df.toDF(*(f"c{n}" for n in range(len(df.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def record_batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def checkpoint_dir(df: DataFrame) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Where it is unset, a folder of our own, but only in single-process local mode.
    """
    session = df.sparkSession
    context = session.sparkContext
    folder = session.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
        folder = context.getCheckpointDir()
    return folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the stored copy.

    Cuts lineage: what follows reads files that survive a lost executor and that hold
    the same rows on every read.
    """
    path = f"{checkpoint_dir(df).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_buckets(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As ``stage``, in buckets by the hash of ``key``: a join on it reads them as they lie."""
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd")
    path = f"{checkpoint_dir(df).rstrip('/')}/{table}"
    writer.option("path", path).bucketBy(buckets, key).saveAsTable(table)
    stored = df.sparkSession.table(table)
    # the files stay; the plan knows their layout without the name
    df.sparkSession.sql(f"DROP TABLE {table}")
    return stored


def pack_array(values: np.ndarray) -> bytes:
    """Bytes of an array; counts and filters are mostly small numbers, which pack well."""
    return zlib.compress(values.tobytes(), 1)


def unpack_array(payload: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(payload), dtype=dtype)


def tree_merge(
    df: DataFrame, merge: Callable[[np.ndarray, np.ndarray], np.ndarray], dtype: str
) -> DataFrame:
    """Merge arrays of one key over all tasks: ``key int, payload binary`` -> one row a key.

    Payloads are packed by ``pack_array``. Two levels, each streaming through its arrays with
    one accumulator, so that memory is the size of one array at any number of tasks.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, key = None, None
        for batch in batches:
            for key, payload in zip(batch.column("key"), batch.column("payload"), strict=True):
                part = unpack_array(payload.as_py(), dtype)
                total = part if total is None else merge(total, part)
        if total is not None:
            yield record_batch(
                {"key": pa.array([key.as_py()], pa.int32()), "payload": pa.array([pack_array(total)], pa.binary())}
            )

    fold.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    schema = "key int, payload binary"
    salted = df.withColumn("salt", F.spark_partition_id() % TREE_FAN)
    first = salted.groupBy("key", "salt").applyInArrow(fold, schema)
    return first.groupBy("key").applyInArrow(fold, schema)
