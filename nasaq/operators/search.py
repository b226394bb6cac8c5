"""Selecting lines: matching, inversion, word boundaries, context and groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import key_column, needs_kernel
from ..functions.kernel import normalize
from ..shipping import ship
from ..sources.lines import logical_lines
from .matchers import Matcher
from .prefilter import can_match
from .spans import SPANS, add_spans, matches_column

#: Key bytes of the patterns that are broadcast at once.
MAX_PATTERN_BYTES = 32 << 20


def match_column(text: Column, m: Matcher, mode: str = "auto", prefilter: bool = True) -> Column:
    """Whether a text matches, in the JVM as far as it goes.

    A literal is searched for in the raw text, by what its letters may be
    spelled as, and no key is made; other matchers take the key.  Texts that
    need the kernel, and matchers that Spark can't express, go to Python, which
    gets NULL for all others.  ``prefilter=False`` always makes the key.
    """
    p = m.profile
    easy = m.raw(text) if prefilter and mode != "udf" else None
    if easy is not None and mode == "auto":
        hard = needs_kernel(text, p)
        return F.when(hard, matches_column(F.when(hard, text), m)).otherwise(easy)
    if (hit := m.native(key_column(text, p, mode))) is None:
        may = can_match(text, m) if prefilter else None
        if may is None:
            return matches_column(text, m)
        return may & F.coalesce(matches_column(F.when(may, text), m), F.lit(False))
    may = can_match(text, m) if prefilter and mode == "auto" else None
    return hit if may is None else may & hit


def candidates(texts: DataFrame, m: Matcher, text: str = "text") -> DataFrame:
    """Rows of whole texts of which a line can match, for searches that aren't inverted.

    Built-in and narrow: texts without a match aren't split into lines at all.
    Without a proof all rows stay.
    """
    may = can_match(F.col(text), m)
    return texts if may is None else texts.where(may)


def _per_text(texts: DataFrame, m: Matcher, text: str, kind: T.DataType, fast: Callable[[Column], Column], slow: Callable[[list[bool]], object]) -> Column:
    """A summary of each whole text's lines, made inside its row: nothing is exploded, shuffled or joined.

    ``fast`` makes it of the raw text; texts that need the kernel, and matchers
    without a predicate on raw text, take ``slow`` over whether each line
    matches, in one Arrow UDF that gets NULL for all others.
    """
    ship(texts.sparkSession)
    col = F.col(text)

    @F.arrow_udf(kind)
    def judge(rows: pa.Array) -> pa.Array:
        out = [None if t is None else slow([m.matches(normalize(m.profile, x)) for x in logical_lines(t)]) for t in rows.to_pylist()]
        return pa.array(out, pa.int64() if isinstance(kind, T.LongType) else pa.bool_())

    if m.raw(col) is None or any("\n" in k or "\r" in k for k in m.keys):
        may = can_match(col, m)
        return judge(col if may is None else F.when(may, col))
    hard = needs_kernel(col, m.profile)
    return F.when(hard, judge(F.when(hard, col))).otherwise(fast(col))


def count_in_texts(texts: DataFrame, m: Matcher, text: str = "text") -> DataFrame:
    """``texts`` with ``selected``, the number of lines that match; nulls have 0."""
    n = _per_text(texts, m, text, T.LongType(), lambda t: F.when(m.raw(t), F.size(F.filter(F.split(t, "\n", -1), m.raw)).cast("long")), sum)
    return texts.withColumn("selected", F.coalesce(n, F.lit(0).cast("long")))


def texts_with(texts: DataFrame, m: Matcher, without: bool = False, text: str = "text") -> DataFrame:
    """Texts of which a line matches, or none does; null texts have no line."""
    hit = F.coalesce(_per_text(texts, m, text, T.BooleanType(), m.raw, any), F.lit(False))
    return texts.where(~hit if without else hit)


def first_in_texts(texts: DataFrame, m: Matcher, text: str = "text", line: str = "line") -> DataFrame:
    """Texts of which a line matches, with ``line``, the number of the first."""
    first = lambda t: F.when(m.raw(t), F.array_position(F.transform(F.split(t, "\n", -1), m.raw), F.lit(True)))
    n = _per_text(texts, m, text, T.LongType(), first, lambda hits: hits.index(True) + 1 if any(hits) else 0)
    return texts.withColumn(line, n.cast("long")).where(F.col(line) > 0)


def select_lines(lines: DataFrame, m: Matcher, *, text: str = "text", invert: bool = False, word: bool = False, spans: bool = False, mode: str = "auto", prefilter: bool = True, only: bool = False) -> DataFrame:
    """``lines`` with ``selected`` and ``spans``; spans are mapped only where they are asked for.

    Inverted lines have spans only with ``word``, where an unbounded match
    still counts for the lines around.  ``only`` leaves out lines that aren't
    selected.  Whether a line matches is asked in the JVM; spans are looked for
    in lines that do, in one Arrow pass.
    """
    ship(lines.sparkSession)
    hit = match_column(F.col(text), m, mode, prefilter)
    none = F.lit(None).cast(SPANS)
    if not word and (invert or not spans):
        out = lines.withColumn("selected", ~hit if invert else hit).withColumn("spans", none)
        return out.where("selected") if only else out
    if only and not invert:
        lines, hit = lines.where(hit), F.lit(True)
    out = add_spans(lines.withColumn("selected", hit), m, text, "selected", word)
    if word:
        found = F.col("spans").isNotNull()
        out = out.withColumn("selected", ~found if invert else found)
        out = out.where("selected") if only else out
    return out if spans else out.withColumn("spans", none)


def with_context(selected: DataFrame, keys: list[str], before: int = 0, after: int = 0, line: str = "line") -> DataFrame:
    """Selected lines and their neighbours, with ``context`` and ``group_start``.

    One window over a file's lines finds the neighbours, and one over what is
    left the groups; without context neither is planned.
    """
    if before < 0 or after < 0:
        raise ValueError("context is negative")
    if not before and not after:
        return selected.where("selected").withColumn("context", F.lit(False)).withColumn("group_start", F.lit(False))
    w = Window.partitionBy(*keys).orderBy(line)
    near = F.max(F.col("selected")).over(w.rowsBetween(-after, before))
    kept = selected.withColumn("_near", near).where("_near").drop("_near")
    gap = F.col(line) > F.lag(line).over(w) + 1
    return kept.withColumn("context", ~F.col("selected")).withColumn("group_start", F.coalesce(gap, F.lit(False)))


def search(df: DataFrame, m: Matcher, *, text: str = "text", keys: list[str] = ("doc_id",), line: str = "line", invert: bool = False, word: bool = False, spans: bool = False, before: int = 0, after: int = 0, mode: str = "auto") -> DataFrame:
    """(keys..., line, text, context, group_start, spans) of the selected lines of a DataFrame of lines."""
    s = select_lines(df, m, text=text, invert=invert, word=word, spans=spans, mode=mode, only=not before and not after)
    return with_context(s, list(keys), before, after, line).select(*keys, line, text, "context", "group_start", "spans")


def count_selected(df: DataFrame, m: Matcher, inputs: DataFrame, *, text: str = "text", keys: list[str] = ("doc_id",), invert: bool = False, word: bool = False, mode: str = "auto") -> DataFrame:
    """(keys..., selected): lines selected of each input; inputs without any have 0.

    Partial sums are made before the shuffle, and only counted lines shuffle.
    """
    s = select_lines(df, m, text=text, invert=invert, word=word, mode=mode, only=True)
    n = s.groupBy(*keys).agg(F.count("*").alias("selected"))
    return inputs.select(*keys).join(n, list(keys), "left").select(*keys, F.coalesce("selected", F.lit(0)).cast("long").alias("selected"))


def inputs_with(df: DataFrame, m: Matcher, inputs: DataFrame, *, without: bool = False, text: str = "text", keys: list[str] = ("doc_id",), invert: bool = False, word: bool = False, mode: str = "auto") -> DataFrame:
    """Inputs with a selected line, or without any: a semi-join or an anti-join."""
    s = select_lines(df, m, text=text, invert=invert, word=word, mode=mode, only=True).select(*keys)
    return inputs.select(*keys).join(s, list(keys), "left_anti" if without else "left_semi")


def first_selected(df: DataFrame, m: Matcher, *, text: str = "text", keys: list[str] = ("doc_id",), line: str = "line", invert: bool = False, word: bool = False, mode: str = "auto") -> DataFrame:
    """(keys..., line): each input's first selected line."""
    s = select_lines(df, m, text=text, invert=invert, word=word, mode=mode, only=True)
    return s.groupBy(*keys).agg(F.min(line).alias(line))


def pattern_join(patterns: DataFrame, texts: DataFrame, *, pattern_key: str, text_key: str, max_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """(text_key, pattern_key) where a text's key contains a pattern's key; each pair once per row of ``texts``.

    ``patterns`` and ``texts`` have a column ``key`` each.  An Aho-Corasick
    automaton finds all patterns in one pass over each text, so no pair is
    formed that isn't in the result.  Patterns go out only while their keys
    take no more than ``max_bytes``; more of them go in slices, a narrow pass each.
    """
    spark = texts.sparkSession
    ship(spark)
    p = patterns.select(F.col(pattern_key).alias("id"), F.col("key").alias("key")).where("id IS NOT NULL AND key <> ''")
    slices = max(1, -(-(p.agg(F.sum(F.octet_length("key"))).first()[0] or 0) // max_bytes))
    kinds = [df.select(c).schema[0].dataType.simpleString() for df, c in ((texts, text_key), (patterns, pattern_key))]
    out = None
    for k in range(slices):
        own = p.where(F.pmod(F.xxhash64("id", "key"), F.lit(slices)) == k)
        shared = spark.sparkContext.broadcast([(r.id, r.key) for r in own.collect()])  # of a checked size
        part = texts.select(F.col(text_key).alias(text_key), F.col("key").alias("key")).mapInArrow(_finder(shared, text_key, pattern_key), f"`{text_key}` {kinds[0]}, `{pattern_key}` {kinds[1]}")
        out = part if out is None else out.unionByName(part)
    return out


def _finder(shared, text_key: str, pattern_key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        ids: dict[str, list] = {}
        for i, key in shared.value:
            ids.setdefault(key, []).append(i)
        find = ahocorasick.Automaton()
        for key, own in ids.items():
            find.add_word(key, own)
        find.make_automaton()
        kind = pa.array([i for i, _ in shared.value]).type
        for b in batches:
            at, found = [], []
            for row, text in enumerate(b.column(1).to_pylist() if ids else []):
                if text:
                    hits = {id(own): own for _, own in find.iter(text)}
                    own = list(dict.fromkeys(i for o in hits.values() for i in o))
                    at += [row] * len(own)
                    found += own
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(found, kind)], names=[text_key, pattern_key])

    return run


def first_faults(lines: DataFrame, keys: list[str], max_line_bytes: int = 0, *, text: str = "text", line: str = "line") -> DataFrame:
    """(keys..., line, error) of each input's first line that is over-long or no valid UTF-8; inputs without one have no row.

    Both faults are judged in the JVM, and one minimum per input is aggregated.
    """
    col = F.col(text)
    error = F.when(~F.is_valid_utf8(col), F.lit("invalid UTF-8"))
    if max_line_bytes:
        error = F.when(F.octet_length(col) > max_line_bytes, F.lit(f"over {max_line_bytes} bytes")).otherwise(error)
    bad = lines.select(*keys, F.struct(F.col(line).alias("line"), error.alias("error")).alias("_f")).where("_f.error IS NOT NULL")
    return bad.groupBy(*keys).agg(F.min("_f").alias("_f")).select(*keys, F.col("_f.line").alias(line), F.col("_f.error").alias("error"))


def until_fault(lines: DataFrame, faults: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """``lines`` before their input's first fault; ``faults`` has a row per faulty input at most."""
    f = faults.select(*keys, F.col(line).alias("_bad"))
    return lines.join(f, keys, "left").where(F.col("_bad").isNull() | (F.col(line) < F.col("_bad"))).drop("_bad")


def status(selected: DataFrame, faults: DataFrame | None = None) -> DataFrame:
    """(selected, status) of a whole search: 0 if a line is selected, 1 if none is, 2 if an input failed."""
    rows = selected.select(F.when(F.col("selected"), 1).otherwise(0).alias("s"), F.lit(0).alias("b"))
    if faults is not None:
        rows = rows.union(faults.select(F.lit(0), F.lit(1)))
    n = rows.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("selected"), F.coalesce(F.max("b"), F.lit(0)).alias("bad"))
    return n.select("selected", F.when(F.col("bad") > 0, 2).when(F.col("selected") > 0, 0).otherwise(1).alias("status"))


def lines_before_errors(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of inputs, without the rows that only carry an error."""
    return lines.where("error IS NULL").drop("error").withColumn("line", F.col("line").cast("long")).select(*keys, "line", "text")
