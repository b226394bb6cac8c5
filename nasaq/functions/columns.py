"""Comparison keys, transliteration and explanations as Spark columns.

Where a key is a function of single code points it stays in the JVM: one
``translate``.  Texts with a code point that needs real decomposition or
reordering go to an Arrow UDF, which gets NULL for all others.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import translit
from .explain import explain
from .kernel import fold_table, key_fold, normalize, normalize_mapped, simple_fold
from .profile import Profile


def _class(points: list[int]) -> str:
    """A Java character class of these code points."""
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        a, b = (f"\\x{{{points[k]:X}}}" for k in (i, j))
        out.append(a if i == j else f"{a}-{b}")
        i = j + 1
    return "[" + "".join(out) + "]"


#: Where one block of code points ends and the next begins.
_EDGES = (0, 0x80, 0x300, 0x600, 0x700, 0x2000, 0x3000, 0xFB50, 0x110000)


def _tiered_class(points: list[int]) -> str:
    """The same class by blocks: a character is compared with the points of its own block only."""
    parts = []
    for a, b in zip(_EDGES, _EDGES[1:]):
        own = [c for c in points if a <= c < b]
        if len(own) < 3:
            parts.append(_class(own)[1:-1])
        else:
            parts.append(f"[[\\x{{{a:X}}}-\\x{{{b - 1:X}}}]&&{_class(own)}]")
    return "[" + "".join(parts) + "]"


#: Ranges of code points without any of the guard that are asked for first, and how long they are at least.
SAFE_RANGES, SAFE_LENGTH = 4, 16


def _guard_class(guard: frozenset[int]) -> str:
    """The class of a guard, which has many ranges.

    Of few ranges among letters those are asked for, and the rest only of points
    behind them; else the few long ranges that hold none of it are asked for first.
    """
    runs, a = [], 0
    low = sorted(x for x in guard if x < 0x700)
    if sum(c - 1 not in guard for c in low) <= SAFE_RANGES:
        return f"[{_class(low)[1:-1]}[[\\x{{700}}-\\x{{10FFFF}}]&&{_tiered_class(sorted(guard - set(low)))}]]"
    for c in [*low, 0x700]:
        if c - a >= SAFE_LENGTH:
            runs.append((a, c - 1))
        a = c + 1
    safe = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in sorted(runs, key=lambda r: r[0] - r[1])[:SAFE_RANGES])
    return f"[[^{safe}]&&{_tiered_class(sorted(guard))}]"


@lru_cache(64)
def native_plan(p: Profile) -> tuple[str, str, str]:
    """(guard, from, to): texts without a match of the guard have the key translate(text, from, to)."""
    guard, fold = simple_fold(p)
    keep = [c for c, v in fold.items() if v is not None]
    gone = [c for c, v in fold.items() if v is None]
    return _guard_class(guard), "".join(map(chr, keep + gone)), "".join(fold[c] for c in keep)


#: Most code points that become several, each a ``replace``; texts with any other go to the kernel.
MAX_REPLACED = 24


@lru_cache(64)
def key_plan(p: Profile) -> tuple[str, str, str, tuple[tuple[str, str], ...]]:
    """(guard, from, to, replaced): as ``native_plan`` for whole keys, with code points that are then replaced by several."""
    guard, fold, kept = key_fold(p)
    many = {c: v for c, v in fold.items() if len(v) > 1}
    if len(many) > MAX_REPLACED:  # letters and the ligatures of lam and alef are met, other ligatures hardly ever
        many = {c: v for c, v in many.items() if c < 0x700 or 0xFEF5 <= c <= 0xFEFC}
    guard = guard | {c for c, v in fold.items() if len(v) > 1 and c not in many}
    keep = [c for c, v in fold.items() if len(v) == 1]
    gone = [c for c, v in fold.items() if not v]
    pattern = _guard_class(guard)
    for i, low in enumerate(kept):
        for high in kept[i + 1 :]:
            pattern += f"|{_class(list(high))}{_tiered_class(sorted(gone))}*+{_class(list(low))}"
    return pattern, "".join(map(chr, keep + gone)), "".join(fold[c] for c in keep), tuple((chr(c), v) for c, v in many.items())


@lru_cache(64)
def _spellings(p: Profile) -> tuple[dict[str, list[int]], str]:
    """(code points other than itself that fold to a letter, class of those that fold to nothing)."""
    _, fold = simple_fold(p)
    out: dict[str, list[int]] = {}
    for c, v in fold.items():
        if v is not None:
            out.setdefault(v, []).append(c)
    gone = sorted(c for c, v in fold.items() if v is None)
    return out, _tiered_class(gone) + "*+" if gone else ""


@lru_cache(1024)
def raw_pattern(key: str, p: Profile) -> str:
    """A Java pattern over the raw text that says exactly whether its key contains ``key``, where the guard has no match.

    Each letter of the key becomes the class of what folds to it; what folds to
    nothing may stand between them.
    """
    guard, fold = simple_fold(p)
    other, gone = _spellings(p)
    classes = []
    for ch in key:
        own = sorted([*other.get(ch, []), *([ord(ch)] if ord(ch) not in fold and ord(ch) not in guard else [])])
        if not own:
            return r"(?!)"
        classes.append(_tiered_class(own))
    return gone.join(classes)


def _normalize_udf(p: Profile):
    @F.pandas_udf(T.StringType())
    def key(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else normalize(p, t))

    return key


def is_ascii(text: Column) -> Column:
    """Such texts are their own keys; no character is looked at one by one."""
    return F.octet_length(text) == F.char_length(text)


def needs_kernel(text: Column, p: Profile) -> Column:
    """Whether a text has a code point that needs real decomposition or reordering."""
    return ~is_ascii(text) & text.rlike(native_plan(p)[0])


def key_column(text: Column, p: Profile, mode: str = "auto") -> Column:
    """The comparison key of a text column.

    ``auto`` is exact on any text; ``native`` plans no Python and fails loudly
    on a text that would need it; ``udf`` always takes the exact kernel.
    """
    if mode == "udf":
        return _normalize_udf(p)(text)
    guard, a, b, replaced = key_plan(p)
    hard = ~is_ascii(text) & text.rlike(guard)
    plain = F.translate(text, a, b)
    for c, key in replaced:
        plain = F.replace(plain, F.lit(c), F.lit(key))
    if mode == "native":
        kernel = F.raise_error(F.lit("a text needs full decomposition; use mode='auto'"))
        return F.when(is_ascii(text), text).when(hard, kernel).otherwise(plain)
    # the kernel has a key of hard texts and NULL of all others: the guard is asked once
    return F.when(is_ascii(text), text).otherwise(F.coalesce(_normalize_udf(p)(F.when(hard, text)), plain))


def mapped_key_column(text: Column, p: Profile) -> Column:
    """struct<key, index>: the key and, for each of its bytes, the byte of the text it came from."""
    kind = T.StructType([T.StructField("key", T.StringType()), T.StructField("index", T.ArrayType(T.IntegerType()))])

    @F.pandas_udf(kind)
    def mapped(texts: pd.Series) -> pd.DataFrame:
        rows = [normalize_mapped(p, t) if t is not None else (None, None) for t in texts]
        return pd.DataFrame({"key": [r[0] for r in rows], "index": [r[1] for r in rows]})

    return mapped(text)


def explain_column(text: Column, profile: str = "search", languages: str = "ar") -> Column:
    """struct<key, rules> of each text, however long."""
    kind = T.StructType([T.StructField("key", T.StringType()), T.StructField("rules", T.ArrayType(T.StringType()))])

    @F.pandas_udf(kind)
    def explained(texts: pd.Series) -> pd.DataFrame:
        rows = [explain(t, profile, languages, None) if t is not None else (None, None) for t in texts]
        return pd.DataFrame({"key": [r[0] for r in rows], "rules": [r[1] for r in rows]})

    # ASCII is its own key and no rule touches it
    plain = F.struct(text.alias("key"), F.array().cast("array<string>").alias("rules"))
    return F.when(is_ascii(text), plain).otherwise(explained(F.when(~is_ascii(text), text)))


def from_latin_column(text: Column, scheme: str = "buckwalter") -> Column:
    """Latin tokens as Arabic letters; one ``translate`` where all tokens are single characters."""
    scheme = translit.parse_scheme(scheme)
    if scheme == "buckwalter":
        latin, arabic = translit.single_character_map(scheme)
        return F.translate(text, latin, arabic)

    @F.pandas_udf(T.StringType())
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else translit.from_latin(t, scheme))

    return convert(text)


def to_latin_column(text: Column, scheme: str = "buckwalter") -> Column:
    """Arabic letters as Latin tokens; multi-character tokens by nested ``replace``."""
    scheme = translit.parse_scheme(scheme)
    pairs = translit._scheme(scheme)[2]
    single = {a: l for a, l in pairs.items() if len(l) == 1}
    out = F.translate(text, "".join(single), "".join(single.values()))
    for a, l in pairs.items():
        if len(l) > 1:
            out = F.replace(out, F.lit(a), F.lit(l))
    return out


def rasm_column(key: Column) -> Column:
    """Letters by their dotless skeleton."""
    from .kernel import RASM

    return F.translate(key, "".join(RASM), "".join(RASM.values()))


def digits_column(text: Column) -> Column:
    """Arabic-Indic digits, both kinds, as ASCII."""
    t = fold_table(Profile(digits=True))
    d = {c: v for c, v in t.items() if v is not None}
    return F.translate(text, "".join(map(chr, d)), "".join(d.values()))


def punctuation_column(text: Column) -> Column:
    """Arabic punctuation as ASCII."""
    d = fold_table(Profile(punctuation=True))
    return F.translate(text, "".join(map(chr, d)), "".join(d.values()))
