"""Character-level transliteration between Latin and Arabic letters."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

_LETTERS = "ءآأؤإئابةتثجحخدذرزسشصضطظعغـفقكلمنهوىيًٌٍَُِّْٰٱ"
_EXTRA = "پچڤگ"
#: Latin tokens for _LETTERS (and what follows them), in the same order.
_TOKENS = {
    "buckwalter": (_LETTERS + _EXTRA, " ".join("'|>&<}AbptvjHxd*rzs$SDTZEg_fqklmnhwYyFNKaui~o`{PJVG")),
    "arabtex": (_LETTERS + _EXTRA, "' 'A 'a 'w 'i 'y A b T t _t ^g .h _h d _d r z s ^s .s .d .t .z ` .g -- f q k l m n h w Y y aN uN iN a u i ~ o _a {A p ^c v g"),
    "iso233": (
        _LETTERS + "،؛؟",
        "ʾ ʾā ʾa ʾw ʾi ʾy ā b ẗ t ṯ ǧ ḥ ẖ d ḏ r z s š ṣ ḍ ṭ ẓ ʿ ġ _ f q k l m n h w ỳ y an un in a u i ː ° á ă , ; ?",
    ),
}
SCHEMES = tuple(_TOKENS)


def parse_scheme(name: str) -> str:
    s = "iso233" if name == "iso-233" else name
    if s not in SCHEMES:
        raise ValueError(f"unknown transliteration {name!r}; choose from {', '.join(SCHEMES)}")
    return s


@lru_cache(None)
def _scheme(scheme: str) -> tuple[re.Pattern, dict[str, str], dict[str, str]]:
    pairs = token_pairs(scheme)
    to_arabic: dict[str, str] = {}
    for a, l in pairs:
        to_arabic.setdefault(l, a)
    longest = sorted(to_arabic, key=lambda t: -len(t.encode("utf-8")))
    return re.compile("|".join(map(re.escape, longest))), to_arabic, dict(pairs)


def token_pairs(scheme: str) -> list[tuple[str, str]]:
    """(Arabic letter, Latin token) of a scheme, in the table's order."""
    letters, tokens = _TOKENS[parse_scheme(scheme)]
    return list(zip(letters, tokens.split(" "), strict=True))


def from_latin(text: str, scheme: str = "buckwalter") -> str:
    """Latin tokens, longest first, as Arabic letters; the rest stays."""
    find, to_arabic, _ = _scheme(scheme)
    if parse_scheme(scheme) == "iso233":
        text = unicodedata.normalize("NFC", text)
    return find.sub(lambda m: to_arabic[m.group()], text)


def to_latin(text: str, scheme: str = "buckwalter") -> tuple[str, list[int]]:
    """(Latin, boundaries): boundaries[i] is where byte i of the text begins in bytes of the Latin."""
    to = _scheme(scheme)[2]
    out, where, n = [], [], 0
    for ch in text:
        t = to.get(ch, ch)
        out.append(t)
        where += [n] * len(ch.encode("utf-8"))
        n += len(t.encode("utf-8"))
    return "".join(out), [*where, n]


def map_boundaries(boundaries: list[int], start: int, end: int) -> tuple[int, int] | None:
    """A byte range of the text as one of the Latin; None if it is out of range."""
    if start < 0 or end < start or end >= len(boundaries):
        return None
    return boundaries[start], boundaries[end]


def single_character_map(scheme: str = "buckwalter") -> tuple[str, str]:
    """(Latin, Arabic) for ``translate``, where every token is one character."""
    letters, tokens = _TOKENS[scheme]
    parts = tokens.split(" ")
    if any(len(t) != 1 for t in parts):
        raise ValueError(f"{scheme} has tokens of several characters")
    return "".join(parts), letters
