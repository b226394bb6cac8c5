"""A whole search over files: discovery, reading, selection, output and status."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import select_lines, with_context
from ..operators.spans import transliterate_match
from ..shipping import ship
from ..sources.discover import STDIN, discover
from ..sources.lines import read_inputs
from .options import Options, UsageError, parse
from .render import count_lines, human_lines, json_lines

_KEYS = ["ord", "file"]


@dataclass
class Result:
    """0: something selected, 1: nothing, 2: an error."""

    status: int
    stdout: str = ""
    stderr: str = ""


def use_color(when: str, terminal: bool = False) -> bool:
    """Whether to color: ``auto`` on a terminal, unless the environment says no."""
    if when != "auto":
        return when == "always"
    return terminal and not os.environ.get("NO_COLOR") and os.environ.get("TERM") != "dumb"


def plan(lines: DataFrame, o: Options, names: bool, color: bool) -> DataFrame:
    """(ord, line, pos, out) of what a search over lines prints, to be ordered by the first three."""
    m = o.matcher()
    spans = o.json or o.only_matching or color
    ok = lines.where("error IS NULL")
    found = with_context(select_lines(ok, m, invert=o.invert, word=o.word, spans=spans), _KEYS, o.before, o.after)
    if o.translit_out:
        found = found.withColumn("_t", transliterate_match(F.col("text"), F.col("spans"))).withColumn("text", F.col("_t.text")).withColumn("spans", F.col("_t.spans"))
    if o.json:
        out = json_lines(found)
    else:
        out = human_lines(found, line_numbers=o.line_numbers, filenames=names, only_matching=o.only_matching, color=color, isolate=not o.no_bidi_isolate)
    pos = F.col("_pos") if "_pos" in out.columns else F.lit(0)
    return out.select("ord", "line", pos.alias("pos"), "context", "out")


def summaries(lines: DataFrame, inputs: DataFrame, o: Options) -> DataFrame:
    """(ord, file, selected, error) of every input, in one aggregation over its lines."""
    s = select_lines(lines.where("error IS NULL"), o.matcher(), invert=o.invert, word=o.word)
    n = s.where("selected").groupBy("ord").agg(F.count("*").alias("selected"))
    bad = lines.where("error IS NOT NULL").groupBy("ord").agg(F.min("error").alias("error"))
    return inputs.join(n, "ord", "left").join(bad, "ord", "left").select("ord", "file", F.coalesce("selected", F.lit(0)).alias("selected"), "error")


def run(spark: SparkSession, argv: list[str], stdin: bytes = b"", terminal: bool = False) -> Result:
    """The command: its output in the order of its inputs, and its status."""
    try:
        o = parse(argv)
        o.matcher()
    except (UsageError, ValueError) as e:
        return Result(2, "", f"error: {e}\n")
    ship(spark)
    inputs, errors = discover(o.paths(), o.recursive, no_ignore=o.no_ignore, includes=o.includes, excludes=o.excludes)
    if not inputs:
        return Result(2 if errors else 1, "", "".join(f"error: {e}\n" for e in errors))
    names = o.filenames if o.filenames is not None else len(inputs) > 1 or o.recursive
    lines = read_inputs(spark, inputs, o.encoding, o.max_line_bytes, stdin, o.threads)
    found = False
    if o.summary:
        table = spark.createDataFrame([(i, label) for i, (_, label) in enumerate(inputs)], "ord int, file string")
        s = count_lines(summaries(lines, table, o), names) if o.count else summaries(lines, table, o)
        rows = s.orderBy("ord").collect()  # one row an input
        errors += [r.error for r in rows if r.error]
        good = [r for r in rows if not r.error]
        if o.count:
            text = [r.out for r in good]
            found = any(r.selected for r in good)
        else:
            text = [r.file for r in good if bool(r.selected) != o.files_without_match]
            found = bool(text)
    else:
        out = plan(lines, o, names, use_color(o.color, terminal))
        rows = out.orderBy("ord", "line", "pos").select("out", "context").toLocalIterator()
        text = []
        for r in rows:
            text.append(r.out)
            found = found or not r.context
        if o.only_matching and not found:
            found = bool(select_lines(lines.where("error IS NULL"), o.matcher(), invert=o.invert, word=o.word).where("selected").limit(1).count())
        errors += [r.error for r in lines.where("error IS NOT NULL").orderBy("ord").collect()]  # one row an input at most
    status = 2 if errors else 0 if found else 1
    return Result(status, "".join(t + "\n" for t in text), "".join(f"error: {e}\n" for e in errors))


def search_files(spark: SparkSession, paths: list[str], query: str | list[str], **options) -> DataFrame:
    """(file, line, text, context, group_start, spans, error) of a search over files, as a DataFrame."""
    o = Options(patterns=[query] if isinstance(query, str) else list(query), operands=list(paths), **options)
    o.check()
    inputs, errors = discover(o.paths(), o.recursive, no_ignore=o.no_ignore, includes=o.includes, excludes=o.excludes)
    lines = read_inputs(spark, [i for i in inputs if i[1] != STDIN], o.encoding, o.max_line_bytes, b"", o.threads)
    s = with_context(select_lines(lines.where("error IS NULL"), o.matcher(), invert=o.invert, word=o.word, spans=not o.summary), _KEYS, o.before, o.after)
    bad = lines.where("error IS NOT NULL")
    if errors:
        bad = bad.unionByName(spark.createDataFrame([(-1, None, None, None, e) for e in errors], bad.schema))
    return s.select("file", "line", "text", "context", "group_start", "spans", F.lit(None).cast("string").alias("error")).unionByName(bad.select("file", "line", "text", "error"), allowMissingColumns=True)
