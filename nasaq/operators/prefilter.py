"""Proofs on raw text that spare normalising it, or splitting it into lines; built-in predicates only.

A literal's anchors are letters that no rule changes and none introduces, but
for presentation forms.  A text without an anchor, and without a form that
expands to it, can't match.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import is_ascii, needs_kernel, raw_pattern
from ..functions.kernel import nfd, normalize
from .matchers import Literal, Matcher

ANCHORS = frozenset("بتثجحخدذرزسشصضطظعغفقلمن")
MAX_KEYS, MAX_VARIANTS = 4, 32
_VARIANTS = {"ه": ("ta_marbuta", "ة"), "ي": ("alef_maksura", "ى")}


def anchors(m: Matcher) -> list[list[str]] | None:
    """Per key its anchor letters, without repeats; None if the proof doesn't hold."""
    if not isinstance(m, Literal) or m.ignore_case or m.profile.rasm or len(m.keys) > MAX_KEYS:
        return None
    out = [list(dict.fromkeys(c for c in k if c in ANCHORS)) for k in m.keys]
    return out if all(out) else None


def can_match(text: Column, m: Matcher) -> Column | None:
    """A necessary condition on raw text: the spelling of a piece that any match has, or a code point that needs the kernel.

    For literals of texts that don't need the kernel it is sufficient too.
    None without such pieces.  ``text`` is evaluated once, whatever it is made of.
    """
    if (pieces := m.factors()) is None:
        return None
    same = [p for p in pieces if p.isascii()]
    pattern = "|".join(raw_pattern(p, m.profile) for p in pieces)

    def may(t: Column) -> Column:
        plain = reduce(Column.__or__, (F.contains(t, F.lit(p)) for p in same)) if same else F.lit(False)
        return F.when(is_ascii(t), plain).otherwise(t.rlike(pattern) | needs_kernel(t, m.profile))

    return F.exists(F.array(text), may)


def _stable(c: str, m: Literal) -> bool:
    raw = "ا" <= c <= "ي" or c == "ی" or (c.isascii() and c.isalnum())
    return raw and normalize(m.profile, c) == c


def proofs(m: Matcher) -> list[str]:
    """Raw spellings whose presence proves a match."""
    if not isinstance(m, Literal) or m.ignore_case:
        return []
    out: dict[str, None] = {}
    for key, query in zip(m.keys, m.queries):
        if all(_stable(c, m) for c in key):
            choices = [(c, _VARIANTS[c][1]) if c in _VARIANTS and getattr(m.profile, _VARIANTS[c][0]) else (c,) for c in key]
            n = 1
            for i, ch in enumerate(choices):
                n *= len(ch)
                if n > MAX_VARIANTS:
                    choices[i:] = [c[:1] for c in choices[i:]]
                    break
            for v in map("".join, product(*choices)):
                if normalize(m.profile, v) == key:
                    out.setdefault(v)
        if query != key and nfd(query) == query and all("ا" <= c <= "ي" or c == "ی" or (c.isascii() and c.isalnum()) for c in query):
            out.setdefault(query)
    return list(out)


def must_match(text: Column, m: Matcher) -> Column | None:
    """A sufficient condition on raw text; only ``contains``, so Parquet readers can apply it too."""
    p = proofs(m)
    return reduce(Column.__or__, (F.contains(text, F.lit(s)) for s in p)) if p else None
