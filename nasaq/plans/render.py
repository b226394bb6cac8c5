"""Output of a search as text columns: JSON Lines, human lines, counts and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spans import PLAIN, RED, highlight_column, only_matching_column
from ..sources.discover import STDIN


def json_lines(found: DataFrame, file: str | None = "file") -> DataFrame:
    """``found`` with ``out``: one JSON object; absent file, false context and empty spans are left out."""
    pairs = F.when(F.size("spans") > 0, F.transform("spans", lambda s: F.array(s["start"], s["end"])))
    cols = [F.col("line").alias("line"), F.col("text").alias("text"), F.when(F.col("context"), F.lit(True)).alias("context"), pairs.alias("spans")]
    if file:
        cols.insert(0, F.when(F.col(file) != STDIN, F.col(file)).alias("file"))
    out = F.to_json(F.struct(*cols))
    # line and paragraph separators end lines in JavaScript
    out = F.replace(F.replace(out, F.lit(" "), F.lit("\\u2028")), F.lit(" "), F.lit("\\u2029"))
    return found.withColumn("out", out)


def human_lines(found: DataFrame, *, line_numbers: bool = False, filenames: bool = False, only_matching: bool = False, color: bool = False, isolate: bool = True, file: str = "file") -> DataFrame:
    """``found`` with ``out``: prefix and text; one row per span where only matches are asked for.

    A new group's first line has ``--`` on a line before it.
    """
    sep = F.when(F.col("context"), F.lit("-")).otherwise(F.lit(":"))
    prefix = F.lit("")
    if filenames:
        prefix = F.concat(prefix, F.col(file), sep)
    if line_numbers:
        prefix = F.concat(prefix, F.col("line").cast("string"), sep)
    if only_matching:
        parts = only_matching_column(F.col("text"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")))
        rows = found.select("*", F.posexplode(parts).alias("_pos", "_part"))
        text = F.col("_part")
        if color:
            whole = F.array(F.struct(F.lit(0).alias("start"), F.octet_length("_part").alias("end")))
            text = highlight_column(F.col("_part"), whole, RED, PLAIN, isolate)
        return rows.withColumn("out", F.concat(prefix, text)).drop("_part")
    text = F.col("text")
    if color:
        text = F.when(F.col("context"), text).otherwise(highlight_column(F.col("text"), F.col("spans"), RED, PLAIN, isolate))
    head = F.when(F.col("group_start"), F.lit("--\n")).otherwise(F.lit(""))
    return found.withColumn("out", F.concat(head, prefix, text))


def count_lines(counts: DataFrame, filenames: bool, file: str = "file") -> DataFrame:
    """``counts`` with ``out``: the number, after the file's name where names are shown."""
    n = F.col("selected").cast("string")
    return counts.withColumn("out", F.concat(F.col(file), F.lit(":"), n) if filenames else n)
