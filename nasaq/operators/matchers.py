"""Matchers: literal, regular-expression and edit-distance search over comparison keys.

A matcher is a small picklable object that is built on the driver, where all
work on the query is done.  ``find_all(key)`` gives byte spans of the key,
``matches(key)`` only whether there is one, and ``native(key)`` is a Spark
predicate over a key column where built-in expressions say the same.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field
from functools import cached_property, reduce

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import is_ascii, raw_pattern
from ..functions.kernel import query_key
from ..functions.profile import Profile

Span = tuple[int, int]


def byte_offsets(s: str) -> list[int]:
    """Byte offset of each character, and the length."""
    out, n = [0], 0
    for ch in s:
        n += 1 if ch < "\x80" else 2 if ch < "ࠀ" else 3 if ch < "\U00010000" else 4
        out.append(n)
    return out


def fold_mapped(s: str) -> tuple[str, list[int]]:
    """(folded, source): full case folding, and the source character of each folded one."""
    parts, source = [], []
    for i, ch in enumerate(s):
        f = ch.casefold()
        parts.append(f)
        source += [i] * len(f)
    return "".join(parts), source


def _checked(queries: list[str]) -> list[str]:
    if not queries:
        raise ValueError("no queries")
    for q in queries:
        q.encode("utf-8")  # a lone surrogate is not valid text
    return list(queries)


@dataclass(frozen=True)
class Literal:
    """Any of several literals, each a comparison key."""

    queries: tuple[str, ...]
    profile: Profile
    ignore_case: bool = False
    keys: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        q = _checked(list(self.queries))
        object.__setattr__(self, "keys", tuple(query_key(self.profile, x, self.ignore_case) for x in q))

    def matches(self, key: str) -> bool:
        k = key.casefold() if self.ignore_case else key
        return any(x in k for x in self.keys)

    def find_all(self, key: str) -> list[Span]:
        """Left to right and not overlapping for each literal; those of different literals may overlap."""
        text, source = fold_mapped(key) if self.ignore_case else (key, None)
        out: list[Span] = []
        off = None
        for k in self.keys:
            at = text.find(k)
            while at >= 0:
                off = off or byte_offsets(key)
                a, b = (at, at + len(k)) if source is None else (source[at], source[at + len(k) - 1] + 1)
                out.append((off[a], off[b]))
                at = text.find(k, at + len(k))
        return sorted(out) if len(self.keys) > 1 else out

    def native(self, key: Column) -> Column | None:
        """None with case folding: Spark has no full case folding."""
        if self.ignore_case:
            return None
        if len(self.keys) == 1:
            return F.contains(key, F.lit(self.keys[0]))
        return key.rlike("|".join(map(_literally, self.keys)))

    def raw(self, text: Column) -> Column | None:
        """The same over raw text that needs no kernel; ASCII text is its own key, so byte search does."""
        if self.ignore_case:
            return None
        plain = [k for k in self.keys if k.isascii()]
        same = reduce(Column.__or__, (F.contains(text, F.lit(k)) for k in plain)) if plain else F.lit(False)
        return F.when(is_ascii(text), same).otherwise(text.rlike("|".join(raw_pattern(k, self.profile) for k in self.keys)))

    def factors(self) -> list[str] | None:
        """Pieces of the key, one of which is in the key of any text that matches."""
        return None if self.ignore_case else list(self.keys)


_CLASSES = {"d": "0-9", "w": "0-9A-Za-z_", "s": r"\t\n\f\r "}
_POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~",
    "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\v\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_EDGE = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


class PatternError(ValueError):
    """A pattern outside the linear-time syntax."""


def translate_pattern(p: str, ignore_case: bool = False) -> str:
    """A linear-time pattern in the syntax that Python's ``regex`` and Java read alike.

    ``\\d \\s \\w \\b`` and POSIX classes are ASCII, ``$`` is the end of the
    text, ``.`` all but a newline.  Backreferences, lookaround, atomic and
    possessive groups are refused.
    """
    out, i, n = [], 0, len(p)
    multi = False
    stack: list[bool] = []
    while i < n:
        c = p[i]
        if c == "\\":
            if i + 1 >= n:
                raise PatternError("trailing backslash")
            d = p[i + 1]
            i += 2
            if d == "Q":
                e = p.find(r"\E", i)
                body, i = (p[i:e], e + 2) if e >= 0 else (p[i:], n)
                out.append("".join("\\" + x if not x.isalnum() and x.isascii() and not x.isspace() else x for x in body))
            elif d == "E":
                continue
            elif d in _CLASSES:
                out.append(f"[{_CLASSES[d]}]")
            elif d.lower() in _CLASSES and d.isupper():
                out.append(f"[^{_CLASSES[d.lower()]}]")
            elif d == "b":
                out.append(_EDGE)
            elif d == "B":
                out.append(f"(?!{_EDGE})")
            elif d == "z":
                out.append(r"(?![\s\S])")
            elif d == "A":
                out.append(r"\A")
            elif d in "pP":
                m = regex.match(r"\{\^?\w+\}|\w", p[i:])
                if not m:
                    raise PatternError("invalid character class")
                name = m.group().strip("{}")
                i += m.end()
                neg = (d == "P") != name.startswith("^")
                out.append(f"\\{'P' if neg else 'p'}{{{_script(name.lstrip('^'))}}}")
            elif d == "x":
                m = regex.match(r"\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{2})", p[i:])
                if not m:
                    raise PatternError("invalid escape")
                i += m.end()
                out.append(_quote(chr(int(m.group(1) or m.group(2), 16))))
            elif d in "01234567":
                if d != "0":
                    raise PatternError("backreferences are not supported")
                m = regex.match(r"[0-7]{0,2}", p[i:])
                i += m.end()
                out.append(_quote(chr(int("0" + m.group(), 8))))
            elif d in "aftnrv":
                out.append(_quote({"a": "\a", "f": "\f", "t": "\t", "n": "\n", "r": "\r", "v": "\v"}[d]))
            elif d == "C" or d.isalnum():
                raise PatternError(f"invalid escape \\{d}")
            else:
                out.append(_quote(d))
            continue
        if c == "[":
            body, i = _bracket(p, i)
            out.append(body)
            continue
        if c == "(":
            stack.append(multi)
            if p.startswith("(?", i):
                m = regex.match(r"\(\?(?:P?<([A-Za-z_][0-9A-Za-z_]*)>|([imsU]*)(?:-([imsU]+))?([:)]))", p[i:])
                if not m or (m.group(1) is None and not (m.group(2) or m.group(3)) and m.group(4) != ":"):
                    raise PatternError("invalid or unsupported group")
                i += m.end()
                if m.group(1) is not None:
                    out.append(f"(?<{m.group(1)}>")
                    continue
                on, off = m.group(2) or "", m.group(3) or ""
                if "U" in on + off:
                    raise PatternError("swapped greediness is not supported")
                multi = (multi or "m" in on) and "m" not in off
                flags = on.replace("m", "").replace("i", "iu") + ("-" + off.replace("m", "") if off.replace("m", "") else "")
                flags = flags.replace("u", "")
                if m.group(4) == ")":
                    stack.pop()
                    out.append(f"(?{flags})" if flags else "")
                else:
                    out.append(f"(?{flags}:")
                continue
            out.append("(")
            i += 1
            continue
        if c == ")":
            if not stack:
                raise PatternError("unexpected )")
            multi = stack.pop()
        if c == "^":
            out.append(r"(?:\A|(?<=\n))" if multi else r"\A")
        elif c == "$":
            out.append(r"(?=\n|(?![\s\S]))" if multi else r"(?![\s\S])")
        elif c == ".":
            out.append(".")
        elif c in "*+?" or (c == "{" and regex.match(r"\{\d+(?:,\d*)?\}", p[i:])):
            m = regex.match(r"[*+?]|\{(\d+)(?:,(\d*))?\}", p[i:])
            if not out or (out[-1] in ("(", "|", "") and not (i and p[i - 1] == ")")):
                raise PatternError("missing argument to repetition operator")
            if m.group(1) and max(int(m.group(1)), int(m.group(2) or 0)) > 1000:
                raise PatternError("invalid repeat count")
            i += m.end()
            lazy = p[i : i + 1] == "?"
            i += lazy
            if p[i : i + 1] in ("*", "+", "?") or regex.match(r"\{\d+(?:,\d*)?\}", p[i:]):
                raise PatternError("invalid nested repetition operator")
            out.append(m.group() + ("?" if lazy else ""))
            continue
        else:
            out.append("\\{" if c == "{" else "\\}" if c == "}" else c if c in "|)" else _quote(c))
        i += 1
    if stack:
        raise PatternError("missing closing )")
    return ("(?i)" if ignore_case else "") + "".join(out)


def _quote(c: str) -> str:
    return c if c.isalnum() or not c.isascii() or c in " _\n\t\r\f\v\a" else "\\" + c if c.isprintable() else f"\\x{ord(c):02x}"


def _script(name: str) -> str:
    return name if len(name) <= 2 or name == "Any" else f"Is{name}"


def _bracket(p: str, i: int) -> tuple[str, int]:
    """A bracket expression that begins at i, rewritten, and where it ends."""
    j, out = i + 1, ["["]
    if p[j : j + 1] == "^":
        out.append("^")
        j += 1
    first = True
    while True:
        if j >= len(p):
            raise PatternError("missing closing ]")
        c = p[j]
        if c == "]" and not first:
            return "".join(out) + "]", j + 1
        first = False
        if p.startswith("[:", j) and (e := p.find(":]", j)) > 0:
            name = p[j + 2 : e]
            if name.lstrip("^") not in _POSIX or name.startswith("^"):
                raise PatternError("invalid character class range")
            out.append(_POSIX[name])
            j = e + 2
        elif c == "\\":
            d = p[j + 1 : j + 2]
            if d in _CLASSES and d:
                out.append(_CLASSES[d])
                j += 2
            elif d in ("p", "P"):
                m = regex.match(r"\{(\^?)(\w+)\}|(\w)", p[j + 2 :])
                if not m:
                    raise PatternError("invalid character class")
                neg = (d == "P") != bool(m.group(1))
                out.append(f"\\{'P' if neg else 'p'}{{{_script(m.group(2) or m.group(3))}}}")
                j += 2 + m.end()
            elif d == "x":
                m = regex.match(r"\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{2})", p[j + 2 :])
                if not m:
                    raise PatternError("invalid escape")
                out.append(_in_class(chr(int(m.group(1) or m.group(2), 16))))
                j += 2 + m.end()
            elif d in ("D", "W", "S") or (d.isalnum() and d not in "aftnrv") or not d:
                raise PatternError("invalid escape in a character class")
            else:
                out.append(_in_class({"a": "\a", "f": "\f", "t": "\t", "n": "\n", "r": "\r", "v": "\v"}.get(d, d)))
                j += 2
        elif c == "-" and out[-1] not in ("[", "^") and p[j + 1 : j + 2] != "]":
            out.append("-")
            j += 1
        else:
            out.append(_in_class(c))
            j += 1


def _in_class(c: str) -> str:
    return "\\" + c if c in "[]\\^-&~|#" or c == '"' else c if c.isprintable() or not c.isascii() else f"\\x{ord(c):02x}"


def _for_python(p: str) -> str:
    """The same pattern for the ``regex`` module, whose scripts go without Is."""
    return regex.sub(r"(\\[pP]\{)Is", r"\1", p)


@dataclass(frozen=True)
class Regex:
    """Any of several patterns over the key; patterns are not normalised."""

    queries: tuple[str, ...]
    profile: Profile
    ignore_case: bool = False

    def __post_init__(self):
        _checked(list(self.queries))
        for q in self.queries:
            try:
                regex.compile(_for_python(translate_pattern(q, self.ignore_case)))
            except regex.error as e:
                raise PatternError(f"invalid pattern {q!r}: {e}") from e

    @cached_property
    def _compiled(self) -> list:
        return [regex.compile(_for_python(translate_pattern(q, self.ignore_case))) for q in self.queries]

    def __getstate__(self):
        return (self.queries, self.profile, self.ignore_case)

    def __setstate__(self, state):
        for k, v in zip(("queries", "profile", "ignore_case"), state):
            object.__setattr__(self, k, v)

    def matches(self, key: str) -> bool:
        return any(c.search(key) for c in self._compiled)

    def find_all(self, key: str) -> list[Span]:
        """All patterns' matches, empty ones too, but not an empty one where the last match ended."""
        out: list[Span] = []
        off = byte_offsets(key)
        for c in self._compiled:
            last, at = -1, 0
            while at <= len(key) and (m := c.search(key, at)):
                a, b = m.span()
                if a < b or a != last:
                    out.append((off[a], off[b]))
                    last = b
                at = b if b > a else b + 1
        return sorted(out)

    def native(self, key: Column) -> Column | None:
        """Java and Python agree on what ``translate_pattern`` gives, scripts' versions and case folding apart."""
        joined = [translate_pattern(q) for q in self.queries]
        if self.ignore_case or any("\\p{" in j or "\\P{" in j or "(?i" in j for j in joined):
            return None
        return key.rlike("(?d)" + "|".join(f"(?:{j})" for j in joined))

    def raw(self, text: Column) -> Column | None:
        return None

    def factors(self) -> list[str] | None:
        return None


class _Bits:
    """Bit-parallel edit distance (Myers) of one pattern; Python integers have any width."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.full = (1 << self.m) - 1
        self.high = 1 << (self.m - 1)
        self.where: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.where[c] = self.where.get(c, 0) | 1 << i

    def scores(self, text, anchored: bool):
        """Distance of the pattern to what ends at each character: from anywhere, or from the first."""
        pv, mv, score, full, high, get = self.full, 0, self.m, self.full, self.high, self.where.get
        for c in text:
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & full
            mh = pv & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
            ph = ph << 1 | anchored
            pv = (mh << 1 | ~(xv | ph)) & full
            mv = ph & xv & full
            yield score


def _free(taken: list[Span], a: int, b: int) -> bool:
    i = bisect_right(taken, (a, 1 << 62))
    return (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b)


@dataclass(frozen=True)
class Fuzzy:
    """Any substring within ``distance`` insertions, deletions or substitutions of code points."""

    queries: tuple[str, ...]
    profile: Profile
    ignore_case: bool = False
    distance: int = 1
    keys: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        if self.distance < 0:
            raise ValueError("fuzzy distance is negative")
        q = _checked(list(self.queries))
        object.__setattr__(self, "keys", tuple(query_key(self.profile, x, self.ignore_case) for x in q))

    @cached_property
    def _bits(self) -> list[tuple[_Bits, _Bits]]:
        return [(_Bits(k), _Bits(k[::-1])) for k in self.keys]

    def __getstate__(self):
        return (self.queries, self.profile, self.ignore_case, self.distance, self.keys)

    def __setstate__(self, state):
        for k, v in zip(("queries", "profile", "ignore_case", "distance", "keys"), state):
            object.__setattr__(self, k, v)

    def matches(self, key: str) -> bool:
        k = key.casefold() if self.ignore_case else key
        return any(s <= self.distance for f, _ in self._bits for s in f.scores(k, False))

    def _candidates(self, text: str):
        d = self.distance
        for forward, back in self._bits:
            for end, s in enumerate(forward.scores(text, False), 1):
                if s > d:
                    continue
                low, most = max(1, back.m - d), min(end, back.m + d)
                best = None
                for n, s in enumerate(back.scores(reversed(text[end - most : end]), True), 1):
                    if n >= low and s <= d and (best is None or (s, -n) < (best[0], -best[1])):
                        best = (s, n)
                if best:
                    yield best[0], end - best[1], end

    def find_all(self, key: str) -> list[Span]:
        """Least distance first, then leftmost, then longest; what overlaps a better one goes."""
        text, source = fold_mapped(key) if self.ignore_case else (key, None)
        taken: list[Span] = []
        for _, a, b in sorted(self._candidates(text), key=lambda c: (c[0], c[1], -c[2])):
            if _free(taken, a, b):
                taken.insert(bisect_right(taken, (a, b)), (a, b))
        off = byte_offsets(key) if taken else []
        out: list[Span] = []
        for a, b in sorted((off[a], off[b]) if source is None else (off[source[a]], off[source[b - 1] + 1]) for a, b in taken):
            if not out or a >= out[-1][1]:
                out.append((a, b))
        return out

    def factors(self) -> list[str] | None:
        """``distance`` + 1 pieces of each key: so many edits leave one of them whole."""
        n = self.distance + 1
        if self.ignore_case or any(len(k) < n for k in self.keys):
            return None
        return [k[i * len(k) // n : (i + 1) * len(k) // n] for k in self.keys for i in range(n)]

    def native(self, key: Column) -> Column | None:
        """Up to one edit: one half of the key is whole, and what stands beside it is the other half with an edit at most."""
        if self.distance == 0 and not self.ignore_case:
            return key.rlike("|".join(map(_literally, self.keys)))
        if self.distance != 1 or self.factors() is None:
            return None
        every = []
        for k in self.keys:
            a, b = k[: len(k) // 2], k[len(k) // 2 :]
            every.append(f"{_literally(a)}(?:{_one_edit(b)})|{_literally(b)}(?<=(?:{_one_edit(a)}){_literally(b)})")
        return key.rlike("(?s)" + "|".join(every))

    def raw(self, text: Column) -> Column | None:
        return None


def _literally(s: str) -> str:
    """A Java pattern of exactly this string."""
    return "".join(c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):X}}}" for c in s)


def _one_edit(s: str) -> str:
    """A Java pattern of all strings within one insertion, deletion or substitution of s."""
    each = [_literally(c) for c in s]
    out = ["".join(each[:i] + ["."] + each[i:]) for i in range(len(s) + 1)]
    out += ["".join(each[:i] + ["."] + each[i + 1 :]) for i in range(len(s))]
    return "|".join(dict.fromkeys(out + ["".join(each[:i] + each[i + 1 :]) for i in range(len(s))]))


Matcher = Literal | Regex | Fuzzy


def build(queries: list[str], profile: Profile, ignore_case: bool = False, kind: str = "literal", distance: int = 1) -> Matcher:
    """A matcher of kind ``literal``, ``regex`` or ``fuzzy``."""
    q = tuple(queries)
    if kind == "regex":
        return Regex(q, profile, ignore_case)
    if kind == "fuzzy":
        return Fuzzy(q, profile, ignore_case, distance)
    return Literal(q, profile, ignore_case)
