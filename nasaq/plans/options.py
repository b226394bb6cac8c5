"""The options of a search, from arguments or from Python."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.profile import OVERRIDES, Profile, resolve
from ..functions.translit import from_latin, parse_scheme
from ..operators.matchers import Matcher, build
from ..sources.decode import parse_encoding


class UsageError(ValueError):
    """Arguments that can't be taken together, or at all."""


@dataclass
class Options:
    patterns: list[str] = field(default_factory=list)
    operands: list[str] = field(default_factory=list)
    profile: str = "search"
    languages: str = "ar"
    overrides: list[str] = field(default_factory=list)
    ignore_case: bool = False
    invert: bool = False
    word: bool = False
    regex: bool = False
    fuzzy: int | None = None
    recursive: bool = False
    includes: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    no_ignore: bool = False
    threads: int | None = None
    encoding: str = "utf8"
    translit: str = ""
    json: bool = False
    line_numbers: bool = False
    count: bool = False
    files_with_matches: bool = False
    files_without_match: bool = False
    after: int = 0
    before: int = 0
    filenames: bool | None = None
    only_matching: bool = False
    color: str = "auto"
    no_bidi_isolate: bool = False
    translit_out: bool = False
    max_line_bytes: int = 0

    @property
    def summary(self) -> bool:
        return self.count or self.files_with_matches or self.files_without_match

    def check(self) -> None:
        """Refuse what conflicts."""
        if self.threads is not None and self.threads < 1:
            raise UsageError("--threads must be at least 1")
        if self.count + self.files_with_matches + self.files_without_match > 1:
            raise UsageError("-c, -l and -L exclude each other")
        if self.json and self.summary:
            raise UsageError("--json can't be combined with -c, -l or -L")
        if self.only_matching and (self.invert or self.summary or self.before or self.after):
            raise UsageError("-o can't be combined with -v, summaries or context")
        if self.regex and self.translit:
            raise UsageError("--regex can't be combined with --translit")
        if self.regex and self.fuzzy is not None:
            raise UsageError("--regex can't be combined with --fuzzy")
        if self.fuzzy is not None and self.fuzzy < 0:
            raise UsageError("--fuzzy needs a distance of 0 or more")
        if self.before < 0 or self.after < 0:
            raise UsageError("context must not be negative")
        if self.max_line_bytes < 0:
            raise UsageError("--max-line-bytes must not be negative")
        if self.color not in ("auto", "always", "never"):
            raise UsageError("--color takes auto, always or never")

    def queries(self) -> list[str]:
        if not self.patterns and not self.operands:
            raise UsageError("missing query")
        q = self.patterns or self.operands[:1]
        if self.translit:
            scheme = parse_scheme(self.translit)
            q = [from_latin(x, scheme) for x in q]
        return list(q)

    def paths(self) -> list[str]:
        return self.operands if self.patterns else self.operands[1:]

    def resolved_profile(self) -> Profile:
        return resolve(self.profile, self.languages, tuple(self.overrides))

    def matcher(self) -> Matcher:
        kind = "regex" if self.regex else "fuzzy" if self.fuzzy is not None else "literal"
        return build(self.queries(), self.resolved_profile(), self.ignore_case, kind, self.fuzzy or 0 if kind == "fuzzy" else 1)


_FLAGS = {
    "i": "ignore_case", "ignore-case": "ignore_case", "v": "invert", "invert-match": "invert", "w": "word", "word-regexp": "word", "regex": "regex",
    "r": "recursive", "recursive": "recursive", "no-ignore": "no_ignore", "j": "json", "json": "json", "n": "line_numbers", "line-number": "line_numbers",
    "c": "count", "count": "count", "l": "files_with_matches", "files-with-matches": "files_with_matches", "L": "files_without_match",
    "files-without-match": "files_without_match", "o": "only_matching", "only-matching": "only_matching", "no-bidi-isolate": "no_bidi_isolate", "translit-out": "translit_out",
}
_VALUES = {"profile": "profile", "lang": "languages", "encoding": "encoding", "translit": "translit", "color": "color"}
_LISTS = {"e": "patterns", "include": "includes", "exclude": "excludes"}
_NUMBERS = {"threads": ("threads",), "max-line-bytes": ("max_line_bytes",), "A": ("after",), "after-context": ("after",), "B": ("before",), "before-context": ("before",), "C": ("after", "before"), "context": ("after", "before")}
_TRUE, _FALSE = ("1", "t", "T", "true", "TRUE", "True"), ("0", "f", "F", "false", "FALSE", "False")


def _number(name: str, text: str) -> int:
    try:
        return int(text, 0)
    except ValueError:
        raise UsageError(f"-{name} needs an integer, not {text!r}") from None


def _boolean(name: str, text: str | None) -> bool:
    if text is None or text in _TRUE:
        return True
    if text in _FALSE:
        return False
    raise UsageError(f"-{name} takes no value {text!r}")


def parse(argv: list[str]) -> Options:
    """Options before operands; the first operand, or ``--``, ends them."""
    o = Options()
    i = 0
    while i < len(argv):
        a = argv[i]
        if len(a) < 2 or a[0] != "-":
            break
        i += 1
        if a == "--":
            break
        name, eq, value = a.lstrip("-").partition("=") if not a.startswith("---") else ("", "", "")
        got = value if eq else None
        if not name:
            raise UsageError(f"bad option {a}")
        if name in _FLAGS:
            setattr(o, _FLAGS[name], _boolean(name, got))
        elif name in ("H", "with-filename", "h", "no-filename"):
            if _boolean(name, got):
                o.filenames = name in ("H", "with-filename")
        elif name.replace("-", "_") in OVERRIDES:
            if _boolean(name, got):
                o.overrides.append(name.replace("-", "_"))
        elif name == "fuzzy":
            o.fuzzy = 1 if got is None else _number(name, got)
            if o.fuzzy < 0:
                raise UsageError("--fuzzy needs a distance of 0 or more")
        elif name in _VALUES or name in _LISTS or name in _NUMBERS:
            if got is None:
                if i >= len(argv):
                    raise UsageError(f"-{name} needs a value")
                got = argv[i]
                i += 1
            if name in _VALUES:
                setattr(o, _VALUES[name], got)
            elif name in _LISTS:
                getattr(o, _LISTS[name]).append(got)
            else:
                for f in _NUMBERS[name]:
                    setattr(o, f, _number(name, got))
        else:
            raise UsageError(f"unknown option -{name}")
    o.operands = argv[i:]
    o.check()
    o.encoding = parse_encoding(o.encoding)
    return o
