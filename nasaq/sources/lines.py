"""Logical lines of text columns and of files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .decode import to_utf8
from .formats import extract


def split_lines(df: DataFrame, text: str = "text", keys: list[str] = ("doc_id",)) -> DataFrame:
    """(keys..., line, text): lines from 1; a line ends at ``\\n``, with one ``\\r`` before it.

    A last line without an end keeps its ``\\r``; an end at the very end begins
    no further line.  Nulls have no lines.
    """
    t = F.col(text)
    # Without the end at the very end; the others are cut away with their \r.
    body = F.when(F.endswith(t, F.lit("\r\n")), F.expr(f"left(`{text}`, length(`{text}`) - 2)")).when(F.endswith(t, F.lit("\n")), F.expr(f"left(`{text}`, length(`{text}`) - 1)")).otherwise(t)
    # Nulls explode to no row. Only the keys go along with the lines: rows that
    # carried their whole text would grow with its square.
    rows = df.select(*keys, F.posexplode(F.when(t != "", F.split(body, "\r?\n", -1))).alias("_i", text))
    return rows.select(*keys, (F.col("_i") + 1).cast("long").alias("line"), text)


def logical_lines(text: str) -> list[str]:
    """The same lines of one string."""
    *ended, last = text.split("\n")
    return [x.removesuffix("\r") for x in ended] + ([last] if last else [])


_SCHEMA = "ord int, file string, line long, text string, error string"


def _file_lines(ord_: int, label: str, data: bytes, limit: int, hint: bool, batch: int = 4096) -> Iterator[pa.RecordBatch]:
    def out(lines: list[str], first: int, error: str | None = None) -> pa.RecordBatch:
        n = len(lines) + (error is not None)
        cols = [[ord_] * n, [label] * n, [*range(first, first + len(lines)), *([None] if error else [])], [*lines, *([None] if error else [])], [None] * len(lines) + ([error] if error else [])]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["ord", "file", "line", "text", "error"])

    lines, first, at, n = [], 1, 0, 0
    while at < len(data):
        e = data.find(b"\n", at)
        raw = data[at:] if e < 0 else data[at:e].removesuffix(b"\r")
        at = len(data) if e < 0 else e + 1
        n += 1
        error = None
        if limit and len(raw) > limit:
            error = f"line {n} exceeds {limit} bytes"
        else:
            try:
                lines.append(raw.decode("utf-8"))
            except UnicodeDecodeError:
                error = f"input is not valid UTF-8 on line {n}" + ("; try --encoding=auto" if hint else "")
        if error:
            yield out(lines, first, f"{label}: {error}")
            return
        if len(lines) >= batch:
            yield out(lines, first)
            first, lines = n + 1, []
    if lines:
        yield out(lines, first)


def _open(path: str, content: bytes | None) -> bytes:
    if content is not None:
        return content
    with open(path, "rb") as f:
        return f.read()


def read_inputs(spark: SparkSession, inputs: list[tuple[str | None, str]], encoding: str = "utf8", max_line_bytes: int = 0, stdin: bytes = b"", partitions: int | None = None) -> DataFrame:
    """(ord, file, line, text, error) of files, one task per group of files.

    A file that can't be read, or has an over-long or invalid line, gives the
    lines before it and one row with ``error``; other files go on.  Hidden
    files, which Spark's own readers skip, are read.
    """
    ship(spark)
    rows = [(i, p, label, stdin if p is None else None) for i, (p, label) in enumerate(inputs)]
    df = spark.createDataFrame(rows, "ord int, path string, label string, content binary")
    n = partitions or min(max(1, len(rows)), spark.sparkContext.defaultParallelism)
    return _decoded(df.repartitionByRange(n, "ord") if n > 1 else df, encoding, max_line_bytes)


def read_store(spark: SparkSession, paths: list[str], encoding: str = "utf8", max_line_bytes: int = 0) -> DataFrame:
    """As ``read_inputs``, through Spark's binary reader, for stores that only Spark opens."""
    ship(spark)
    df = spark.read.format("binaryFile").load(paths).select(F.lit(0).alias("ord"), "path", F.col("path").alias("label"), "content")
    return _decoded(df, encoding, max_line_bytes)


def _decoded(df: DataFrame, encoding: str, limit: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ord_, path, label, content in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    raw = _open(path, content)
                    text = extract(path, raw) if path else None
                    if text is not None:
                        if encoding not in ("utf8", "auto"):
                            raise ValueError(f"extracted document text is UTF-8 and cannot use --encoding={encoding}")
                        data = text.encode("utf-8")
                    else:
                        data, _ = to_utf8(raw, encoding)
                except Exception as e:  # one bad input is its own error row
                    what = e.strerror if isinstance(e, OSError) and e.strerror else str(e)
                    yield pa.RecordBatch.from_arrays([pa.array([ord_], pa.int32()), pa.array([label]), pa.array([None], pa.int64()), pa.array([None], pa.string()), pa.array([f"{label}: {what}"])], names=["ord", "file", "line", "text", "error"])
                    continue
                yield from _file_lines(ord_, label, data, limit, encoding == "utf8")

    return df.mapInArrow(run, _SCHEMA)
