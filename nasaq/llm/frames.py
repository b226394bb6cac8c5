"""Small DataFrame and Arrow helpers shared by the operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names (the first of each), whatever else clashes.

    Spark resolves names without case, so a table that also has ``Text`` or a
    second ``text`` can't be asked for ``text`` directly.
    """
    ship(df.sparkSession)
    have = df.columns
    lower = [c.lower() for c in have]
    if all(lower.count(n.lower()) == 1 and n in have for n in names):
        return df.select(*names)
    at = [have.index(n) for n in names]
    plain = df.toDF(*[f"_c{i}" for i in range(len(have))])
    return plain.select(*[F.col(f"_c{i}").alias(n) for i, n in zip(at, names)])


def unclash(df: DataFrame, reads: list[str], adds: list[str] = ()) -> DataFrame:
    """``df`` without extra columns whose names, ignoring case, clash with one read or added, or with each other."""
    have, taken, keep = df.columns, {n.lower() for n in (*reads, *adds)}, []
    own = {have.index(n) for n in reads}
    for i, n in enumerate(have):
        if i in own or n.lower() not in taken:
            keep.append(i)
            taken.add(n.lower())
    if len(keep) == len(have):
        return df
    plain = df.toDF(*[f"_c{i}" for i in range(len(have))])
    return plain.select(*[F.col(f"_c{i}").alias(have[i]) for i in keep])


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or one of our own where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="nasaq-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_STAGED: list[tuple[SparkSession, str]] = []


def _sweep() -> None:
    while _STAGED:
        spark, path = _STAGED.pop()
        try:
            drop(spark, path)
        except Exception:  # the session may be gone at exit
            return


atexit.register(_sweep)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a staged table from whatever store holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/nasaq/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "lz4_raw").parquet(path)
    _STAGED.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; what is made of them must be written by then."""
    for df in staged:
        drop(df.sparkSession, df._staged_at)
        _STAGED.remove((df.sparkSession, df._staged_at))


def clean(spark: SparkSession) -> None:
    """Have the driver's JVM collect its garbage: only then does Spark delete shuffle files and broadcasts of finished jobs.

    Otherwise that waits for spark.cleaner.periodicGC.interval, half an hour.
    """
    spark.sparkContext._jvm.System.gc()


def add_columns(
    df: DataFrame,
    fields: list[T.StructField],
    make: Callable[[pa.RecordBatch], list[pa.Array]],
    using: list[str],
) -> DataFrame:
    """``df`` with columns appended that ``make`` derives from the columns ``using``.

    A narrow, Arrow-batched map; ``make`` sees only the columns it asked for.
    """
    ship(df.sparkSession)
    at = [df.columns.index(n) for n in using]
    schema = T.StructType(df.schema.fields + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = pa.RecordBatch.from_arrays([b.column(i) for i in at], names=using)
            new = make(asked)
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *(f.name for f in fields)])

    return df.mapInArrow(run, schema)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string (UTF-8) or binary column; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        kind = np.int32
    elif pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        col, kind = col.cast(pa.string()), np.int32
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    o = np.frombuffer(off, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    x = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if col.null_count:  # what lies under a null is undefined
        ok = np.asarray(col.is_valid())
        if np.any(np.diff(o)[~ok]):
            return text_bytes(col.fill_null(b"" if "binary" in str(col.type) else ""))
    return x, o


#: Bytes of text that a kernel takes at once; its arrays take many times that.
KERNEL_BYTES = 1 << 20


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = KERNEL_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows with ``most`` bytes of a column together, or one row with more; nothing is copied."""
    for b in batches:
        o = text_bytes(b.column(column))[1]
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(o, o[i] + most, "right")) - 1)
            yield b.slice(i, min(j, b.num_rows) - i)
            i = j
        if not b.num_rows:
            yield b


def crc_bucket(doc_id: str, mod: int) -> "F.Column":
    """crc32 of the id's decimal text, modulo; a null id counts as remainder -1."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(mod)), F.lit(-1).cast("long"))
