"""The exact comparison key of one string, with or without a map back to its bytes.

``key = NFD(fold(NFD(language(presentation(s)))))``.  Each rule is a function of
one code point, but for hamza and madda marks, which depend on the letter that
carries them.  So the rules compile to one translation table, and only strings
with such a mark take the slow path.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from .profile import Profile

ALEF, WAW, YEH = "ا", "و", "ي"
MADDA, HAMZA_ABOVE, HAMZA_BELOW = "ٓ", "ٔ", "ٕ"
_HAMZA_MARKS = frozenset((MADDA, HAMZA_ABOVE, HAMZA_BELOW))
_BIDI = [0x061C, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2066, 0x206A)]
#: Letters that share a skeleton, led by the one that stands for them.
_SKELETONS = {"ٮ": "بتثني", "ح": "جخ", "د": "ذ", "ر": "ز", "س": "ش", "ص": "ض", "ط": "ظ", "ع": "غ", "ٯ": "فق"}
RASM = {c: k for k, v in _SKELETONS.items() for c in v}
_PUNCTUATION = {",": "،٬", ";": "؛", "?": "؟", "%": "٪", ".": "٫۔"}

nfd = lambda s: unicodedata.normalize("NFD", s)


@lru_cache(None)
def marks(scope: str) -> frozenset[int]:
    """Code points that count as vowel signs."""
    if scope == "all":
        return frozenset(c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Mn")
    return frozenset(range(0x064B, 0x0653)) | (frozenset({0x0670}) if scope == "harakat+dagger" else frozenset())


@lru_cache(None)
def presentation_forms() -> dict[int, str]:
    """Arabic presentation forms and what they stand for, from the character database."""
    out = {}
    for c in (*range(0xFB50, 0xFE00), *range(0xFE70, 0xFF00)):
        tag, _, rest = unicodedata.decomposition(chr(c)).partition(" ")
        if tag in ("<isolated>", "<initial>", "<medial>", "<final>"):
            out[c] = "".join(chr(int(x, 16)) for x in rest.split())
    return out


@lru_cache(64)
def fold_table(p: Profile) -> dict[int, str | None]:
    """Context-free part of the rules on decomposed text: a code point to its fold, or None to drop it."""
    t: dict[int, str | None] = {}
    if p.tashkil:
        t |= dict.fromkeys(marks(p.scope))
    for on, drop in ((p.bidi, _BIDI), (p.joiners, [0x200D]), (p.joiners and not p.keeps_zwnj, [0x200C]), (p.tatweel, [0x0640])):
        if on:
            t |= dict.fromkeys(drop)
    for c in range(0x06D6, 0x06EE):  # goes before the vowel signs
        t.pop(c, None)
        if p.quranic:
            t[c] = None
    if p.digits:
        t |= {z + i: str(i) for z in (0x0660, 0x06F0) for i in range(10)}
    if p.punctuation:
        t |= {ord(c): k for k, v in _PUNCTUATION.items() for c in v}
    if p.crosses_arabic:
        t |= {0x06A9: "ك", 0x06CC: YEH}
        if "ur" in p.languages:
            t[0x06C1] = "ه"
    for on, a, b in ((p.alef_wasla, 0x0671, ALEF), (p.ta_marbuta, 0x0629, "ه"), (p.alef_maksura, 0x0649, YEH)):
        if on:
            t[a] = b
    return t


def _rasm(t: dict[int, str | None]) -> dict[int, str | None]:
    folded = {c: v if v is None else RASM.get(v, v) for c, v in t.items()}
    return {ord(c): k for c, k in RASM.items() if ord(c) not in t} | folded


@lru_cache(64)
def _tables(p: Profile) -> tuple[dict, dict, dict]:
    """(fold, fold with rasm, what goes before decomposition)."""
    t = fold_table(p)
    first: dict[int, str] = dict(presentation_forms()) if p.presentation else {}
    if "fa" in p.languages:
        first = {c: v.replace("ۀ", "ه") for c, v in first.items()} | {0x06C0: "ه"}
    return t, _rasm(t) if p.rasm else t, first


@lru_cache(None)
def _decompositions() -> tuple[dict[int, int], frozenset[int], frozenset[int]]:
    """(code point -> base, where only nonspacing marks follow it; other decompositions; marks that are no Mn but reorder)."""
    base, other, moving = {}, set(), set()
    mn = marks("all")
    for c in range(sys.maxunicode + 1):
        if 0xD800 <= c < 0xE000:
            continue
        d = nfd(chr(c))
        if d != chr(c):
            if ord(d[0]) not in mn and all(ord(x) in mn for x in d[1:]):
                base[c] = ord(d[0])
            else:
                other.add(c)
        elif unicodedata.combining(chr(c)) and c not in mn:
            moving.add(c)
    return base, frozenset(other), frozenset(moving)


def drops_all_marks(p: Profile) -> bool:
    """Whether every nonspacing mark goes, so that neither carriers nor order matter."""
    return p.tashkil and p.scope == "all" and p.alef_hamza and p.hamza_seat and p.quranic


@lru_cache(64)
def simple_fold(p: Profile) -> tuple[frozenset[int], dict[int, str | None]]:
    """(guard, fold): texts without a code point of the guard have the key that ``fold`` gives code point by code point."""
    base, other, moving = _decompositions()
    _, full, _ = _tables(p)
    forms = frozenset(presentation_forms()) if p.presentation else frozenset()
    mn = marks("all")
    fold = {c: v for c, v in full.items() if v != chr(c)}
    if drops_all_marks(p):
        guard = other | moving | forms
        for c, b in base.items():
            if c not in guard:
                fold[c] = full.get(b, chr(b))
        if "fa" in p.languages:
            fold[0x06C0] = full.get(0x0647, "ه")
        fold |= dict.fromkeys(mn - other)
    else:
        guard = other | moving | forms | frozenset(base) | mn
        fold = {c: v for c, v in fold.items() if c not in mn}
    return frozenset(guard), {c: v for c, v in fold.items() if c not in guard}


@lru_cache(64)
def key_fold(p: Profile) -> tuple[frozenset[int], dict[int, str], tuple[tuple[int, ...], ...]]:
    """(guard, fold, kept): as ``simple_fold``, but for whole keys only, where a code point may become several.

    Where every nonspacing mark goes but hamza and Quranic ones, those are all
    that is looked at: raw hamza marks that some letter keeps are in the guard,
    a letter that carries one is folded with it.  ``kept`` are the Quranic marks
    that stay, by combining class; if two of them stand in falling order, with
    nothing but dropped points between, the text needs reordering.
    """
    guard, fold = simple_fold(p)
    if drops_all_marks(p) and not p.presentation or not (p.tashkil and p.scope == "all"):
        return guard, {c: v or "" for c, v in fold.items()}, ()
    base, other, moving = _decompositions()
    _, full, first = _tables(p)
    mn = marks("all")
    stay = [c for c in mn if c not in full and 0x06D6 <= c < 0x06EE]
    hamza = set() if p.alef_hamza and p.hamza_seat else set(map(ord, _HAMZA_MARKS))
    hard = set(other | moving | hamza)
    out = {c: v or "" for c, v in full.items() if v != chr(c)}
    out |= {ord(m): "" for m in _HAMZA_MARKS if not hamza}
    for c in (*base, *first):
        d = nfd(first.get(c, chr(c)))
        # what a letter does to its own marks is known if it stays, and it alone
        if d[0] in map(chr, mn) or full.get(ord(d[0]), "x") is None and not _HAMZA_MARKS.isdisjoint(d):
            hard.add(c)
            continue
        key = normalize(p, chr(c))
        if stay and any(ord(x) in mn for x in key):
            hard.add(c)
        else:
            hard.discard(c)
            out[c] = key
    kinds = sorted({unicodedata.combining(chr(c)) for c in stay} - {0})
    kept = tuple(tuple(sorted(c for c in stay if unicodedata.combining(chr(c)) == k)) for k in kinds)
    return frozenset(hard), {c: v for c, v in out.items() if c not in hard and v != chr(c)}, kept


def _drops_mark(p: Profile, r: str, base: str) -> bool:
    """Whether a hamza or madda mark goes, by the letter that carries it."""
    if base == ALEF:
        return p.alef_hamza
    if r == HAMZA_ABOVE and base in (WAW, YEH):
        return p.hamza_seat or (p.rasm and base == YEH)
    return p.tashkil and ord(r) in marks(p.scope)


def _walk(p: Profile, runes):
    """(rune, fold or None) of each rune of decomposed text; tracks the letter that carries a mark."""
    plain, full, _ = _tables(p)
    all_marks = marks("all")
    base = ""
    for r in runes:
        c = ord(r)
        if r in _HAMZA_MARKS:
            gone = _drops_mark(p, r, base)
            out, before_rasm = (None, r) if gone else (r, r)
        else:
            out, before_rasm = full.get(c, r), plain.get(c, r)
            gone = out is None
        yield out
        if not gone and before_rasm in (ALEF, WAW, YEH):
            base = before_rasm
        elif not (base and (gone or c in all_marks)):
            base = ""


def normalize(p: Profile, s: str) -> str:
    """The comparison key of s."""
    if s.isascii():
        return s
    _, full, first = _tables(p)
    d = nfd(s.translate(first) if first else s)
    if HAMZA_ABOVE in d or MADDA in d or HAMZA_BELOW in d:
        out = "".join(x for x in _walk(p, d) if x is not None)
    else:
        out = d.translate(full)
    return nfd(out)


def decomposed(p: Profile, s: str) -> str:
    """What the rules of one code point are applied to."""
    first = _tables(p)[2]
    return nfd(s.translate(first) if first else s)


def touched(p: Profile, q: Profile) -> frozenset[str]:
    """Points that two profiles may treat differently: a text has the same key of both if neither it nor its ``decomposed`` form has one."""
    out = {c for a, b in zip(_tables(p), _tables(q)) for c in a.keys() | b.keys() if a.get(c, chr(c)) != b.get(c, chr(c))}
    if any(getattr(p, x) != getattr(q, x) for x in ("alef_hamza", "hamza_seat", "tashkil", "scope", "rasm")):
        out |= set(map(ord, _HAMZA_MARKS))
    return frozenset(map(chr, out))


def _order(tokens: list[list]) -> None:
    """Canonical order inside each run of marks; all of a cluster take the cluster's interval."""
    i, n = 0, len(tokens)
    while i < n:
        j = i + 1
        while j < n and tokens[j][1]:
            j += 1
        if j - i > 1:
            k = i if tokens[i][1] else i + 1
            tokens[k:j] = sorted(tokens[k:j], key=lambda t: t[1])
            lo, hi = min(t[2] for t in tokens[i:j]), max(t[3] for t in tokens[i:j])
            for t in tokens[i:j]:
                t[2], t[3] = lo, hi
        i = j


@lru_cache(64)
def _guard(p: Profile) -> re.Pattern:
    return re.compile("[" + "".join(map(re.escape, map(chr, sorted(simple_fold(p)[0])))) + "]")


_BEYOND_ASCII = re.compile(r"[^\x00-\x7F]")


def _mapped_simply(p: Profile, s: str, size: int) -> tuple[str, list[int]]:
    """``normalize_mapped`` of a text whose key is made code point by code point; ASCII goes over in runs."""
    fold, key, index, done, at = simple_fold(p)[1], [], [], 0, 0
    for m in _BEYOND_ASCII.finditer(s):
        i, ch = m.start(), m.group()
        key.append(s[done:i])
        index += range(at, at + i - done)
        at += i - done
        out = fold.get(ord(ch), ch)
        if out:
            key.append(out)
            index += [at] * len(out.encode("utf-8"))
        at += len(ch.encode("utf-8"))
        done = i + 1
    key.append(s[done:])
    index += range(at, size + 1)
    return "".join(key), index


def normalize_mapped(p: Profile, s: str) -> tuple[str, list[int]]:
    """(key, index): index[i] is the byte of s where byte i of the key began; its last entry is the length of s."""
    size = len(s.encode("utf-8"))
    if s.isascii():
        return s, list(range(size + 1))
    if not _guard(p).search(s):
        return _mapped_simply(p, s, size)
    _, _, first = _tables(p)
    tokens, at = [], 0
    ccc = unicodedata.combining
    for ch in s:
        end = at + (1 if ch < "\x80" else 2 if ch < "ࠀ" else 3 if ch < "\U00010000" else 4)
        for r in nfd(first.get(ord(ch), ch)):
            tokens.append([r, ccc(r), at, end])
        at = end
    _order(tokens)
    kept = []
    for t, out in zip(tokens, _walk(p, [t[0] for t in tokens])):
        if out is not None:
            if out != t[0]:
                t[0], t[1] = out, ccc(out)
            kept.append(t)
    _order(kept)
    index = []
    for r, _, a, _ in kept:
        index += [a] * len(r.encode("utf-8"))
    index.append(size)
    return "".join(t[0] for t in kept), index


def map_span(index: list[int], start: int, end: int) -> tuple[int, int]:
    """A half-open byte range of the key as one of the original; invalid ranges give (0, 0).

    The end moves past bytes of the same origin, so a match of one component
    of a ligature covers the whole of it.
    """
    if not index or start < 0 or end < start or end >= len(index):
        return 0, 0
    a = index[start]
    if start == end:
        return a, a
    b, i = index[end], end + 1
    while b <= a and i < len(index):
        b, i = index[i], i + 1
    return a, max(a, b)


class EmptyKeyError(ValueError):
    """A query that normalises to nothing."""


def query_key(p: Profile, query: str, ignore_case: bool = False) -> str:
    """The key of a literal or fuzzy query."""
    key = normalize(p, query)
    if not key:
        raise EmptyKeyError("query is empty after normalization")
    return key.casefold() if ignore_case else key
