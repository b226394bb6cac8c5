"""Search over streams of lines with Structured Streaming.

Selection is stateless and runs in append mode.  Context needs a few lines of
state per input, kept by ``applyInPandasWithState``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.matchers import Matcher
from ..operators.search import select_lines
from ..shipping import ship


def read_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A stream of (file, text) lines; only a newline ends a line, and one carriage return before it goes."""
    r = spark.readStream.format("text").option("lineSep", "\n")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    text = F.regexp_replace("value", "\r\\z", "")
    return r.load(path).select(F.input_file_name().alias("file"), text.alias("text"))


def search_stream(lines: DataFrame, m: Matcher, *, text: str = "text", invert: bool = False, word: bool = False, spans: bool = False) -> DataFrame:
    """Selected lines of a stream as they come, with ``spans``; a narrow plan without state."""
    return select_lines(lines, m, text=text, invert=invert, word=word, spans=spans).where("selected").drop("selected")


_STATE = "lines array<bigint>, texts array<string>, after int, last bigint"
_OUT = "file string, line bigint, text string, context boolean, group_start boolean"


def search_stream_context(lines: DataFrame, m: Matcher, *, before: int = 0, after: int = 0, invert: bool = False, word: bool = False) -> DataFrame:
    """(file, line, text, context, group_start) of a stream of (file, line, text) with lines in context.

    Lines of a file come in order from batch to batch; state per file is the
    last ``before`` lines, how many lines still follow a selected one, and the
    last line that went out.
    """
    if before < 0 or after < 0:
        raise ValueError("context is negative")
    ship(lines.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ln, tx, follow, last = state.get if state.exists else ([], [], 0, 0)
        waiting = list(zip(ln, tx))
        rows = pd.concat(list(batches)).sort_values("line")
        out: list[tuple] = []

        def emit(n: int, t: str, context: bool) -> None:
            nonlocal last
            out.append((key[0], n, t, context, bool(last) and n > last + 1))
            last = n

        for n, t, hit in zip(rows["line"].tolist(), rows["text"].tolist(), rows["selected"].tolist()):
            if hit:
                for a, b in waiting:
                    if a > last:
                        emit(a, b, True)
                waiting = []
                emit(n, t, False)
                follow = after
            elif follow:
                emit(n, t, True)
                follow -= 1
            elif before:
                waiting = [*waiting, (n, t)][-before:]
        state.update(([a for a, _ in waiting], [b for _, b in waiting], follow, last))
        yield pd.DataFrame(out, columns=["file", "line", "text", "context", "group_start"])

    s = select_lines(lines, m, invert=invert, word=word).select("file", "line", "text", "selected")
    return s.groupBy("file").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
