"""Spans on the original text, in one fused Arrow UDF, and what follows from them."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernel import map_span, normalize, normalize_mapped
from ..functions.translit import map_boundaries, to_latin
from .matchers import Matcher

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def is_word(c: str, zwnj: bool) -> bool:
    return c == "_" or (c == "‌" and zwnj) or unicodedata.category(c)[0] in "LNM"


def word_bounded(raw: bytes, start: int, end: int, zwnj: bool) -> bool:
    """Whether neither neighbour of a byte range of the original text is a word character."""
    if start < 0 or end < start or end > len(raw):
        return False
    if start and is_word(raw[max(0, start - 4) : start].decode("utf-8", "ignore")[-1:] or " ", zwnj):
        return False
    return not (end < len(raw) and is_word(raw[end : end + 4].decode("utf-8", "ignore")[:1] or " ", zwnj))


def search_text(m: Matcher, text: str, word: bool = False, known: bool = False) -> list[tuple[int, int]] | None:
    """Spans of a line, neighbours that are equal once; None if nothing is found.  ``known`` says that it matches."""
    p = m.profile
    if not known and not m.matches(normalize(p, text)):
        return None
    key, index = normalize_mapped(p, text)
    raw = text.encode("utf-8") if word else b""
    out: list[tuple[int, int]] = []
    found = False
    for a, b in m.find_all(key):
        if a < 0 or b < a or b >= len(index):
            continue
        s = map_span(index, a, b)
        if word and not word_bounded(raw, *s, p.keeps_zwnj):
            continue
        found = True
        if not out or out[-1] != s:
            out.append(s)
    return out if found else None


def _spans_array(rows: list[list[tuple[int, int]] | None]) -> pa.Array:
    off = [0]
    for r in rows:
        off.append(off[-1] + len(r or ()))
    flat = [x for r in rows if r for x in r]
    pair = pa.StructArray.from_arrays([pa.array([a for a, _ in flat], pa.int32()), pa.array([b for _, b in flat], pa.int32())], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pair, mask=pa.array([r is None for r in rows], pa.bool_()))


def spans_column(text: Column, m: Matcher, word: bool = False, known: bool = False) -> Column:
    """array<struct<start, end>> of each text's spans in bytes; null if it doesn't match."""

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        return _spans_array([None if t is None else search_text(m, t, word, known) for t in texts.to_pylist()])

    return spans(text)


def add_spans(lines: DataFrame, m: Matcher, text: str, hit: str, word: bool) -> DataFrame:
    """``lines`` with ``spans`` of the rows where ``hit`` is true; one Arrow pass that later filters don't repeat."""
    at, told = lines.columns.index(text), lines.columns.index(hit)
    schema = T.StructType([*lines.schema.fields, T.StructField("spans", SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [search_text(m, t, word, True) if h else None for t, h in zip(b.column(at).to_pylist(), b.column(told).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, _spans_array(rows)], names=[*b.schema.names, "spans"])

    return lines.mapInArrow(run, schema)


def matches_column(text: Column, m: Matcher) -> Column:
    """Whether each text matches; no map of bytes is made."""

    @F.arrow_udf(T.BooleanType())
    def hit(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else m.matches(normalize(m.profile, t)) for t in texts.to_pylist()], pa.bool_())

    return hit(text)


RED, PLAIN, ISOLATE, POP = "\x1b[01;31m", "\x1b[m", "⁧", "⁩"


def merged(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Spans that overlap or touch as one; empty and invalid ones go."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if a < 0 or b <= a or b > size:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _rtl(s: str) -> bool:
    return any(unicodedata.bidirectional(c) in ("R", "AL") or ("؀" <= c <= "ۿ" and unicodedata.category(c) in ("Mn", "Nd") and c not in "٠١٢٣٤٥٦٧٨٩") for c in s)


def mark(text: str, spans: list[tuple[int, int]], before: str = RED, after: str = PLAIN, isolate: bool = True) -> str:
    """The text with its spans between ``before`` and ``after``; right-to-left ones isolated."""
    raw = text.encode("utf-8")
    out, at = [], 0
    for a, b in merged(spans, len(raw)):
        found = raw[a:b].decode("utf-8", "replace")
        wrap = isolate and _rtl(found)
        out += [raw[at:a].decode("utf-8", "replace"), ISOLATE if wrap else "", before, found, after, POP if wrap else ""]
        at = b
    return "".join(out) + raw[at:].decode("utf-8", "replace") if out else text


def highlight_column(text: Column, spans: Column, before: str = RED, after: str = PLAIN, isolate: bool = True) -> Column:
    """``mark`` over columns; e.g. ``<mark>`` and ``</mark>``."""

    @F.pandas_udf(T.StringType())
    def marked(texts: pd.Series, all_spans: pd.Series) -> pd.Series:
        none = lambda s: s is None or (isinstance(s, float) and np.isnan(s))
        return pd.Series([None if t is None else mark(t, [] if none(s) else [(int(x["start"]), int(x["end"])) for x in s], before, after, isolate) for t, s in zip(texts, all_spans)], dtype=object)

    return marked(text, spans)


def only_matching_column(text: Column, spans: Column) -> Column:
    """array<string> of the spans' texts, empty spans left out; built-in."""
    raw = text.cast("binary")
    full = F.filter(spans, lambda s: s["start"] < s["end"])
    return F.transform(full, lambda s: F.substring(raw, s["start"] + 1, s["end"] - s["start"]).cast("string"))


def transliterate_match(text: Column, spans: Column) -> Column:
    """struct<text, spans>: a line in Buckwalter letters and its spans moved along."""
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", SPANS)])

    @F.arrow_udf(kind)
    def render(texts: pa.Array, all_spans: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(texts.to_pylist(), all_spans.to_pylist()):
            if t is None:
                out.append({"text": None, "spans": None})
                continue
            latin, where = to_latin(t)
            moved = None if s is None else [{"start": m[0], "end": m[1]} for x in s if (m := map_boundaries(where, x["start"], x["end"]))]
            out.append({"text": latin, "spans": moved})
        return pa.array(out, pa.struct([("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]))

    return render(text, spans)
