"""Which files a search reads: arguments, directories, globs and ignore files."""

from __future__ import annotations

import os
import posixpath
import re
import stat
from dataclasses import dataclass


def compile_glob(pattern: str) -> re.Pattern:
    """``*`` and ``?`` stay inside a path segment, ``**`` doesn't."""
    p = posixpath.normpath(pattern.strip()) if pattern.strip() else "."
    if p == ".":
        raise ValueError("empty pattern")
    out = [r"\A"]
    i = 0
    while i < len(p):
        if p.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif p.startswith("**", i):
            out.append(".*")
            i += 2
        elif p[i] == "*":
            out.append("[^/]*")
            i += 1
        elif p[i] == "?":
            out.append("[^/]")
            i += 1
        elif p[i] == "[":
            end = p.find("]", i + 1)
            if end < 0:
                raise ValueError("unterminated character class")
            body = p[i + 1 : end]
            if not body:
                raise ValueError("empty character class")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body).replace("[", r"\[") + "]")
            i = end + 1
        else:
            out.append(re.escape(p[i]))
            i += 1
    try:
        return re.compile("".join(out) + r"/?\Z")
    except re.error as e:
        raise ValueError(str(e)) from e


class Filters:
    """Include and exclude globs; a glob without a slash fits at any depth."""

    def __init__(self, includes: list[str] = (), excludes: list[str] = ()):
        deep = lambda g: compile_glob(g if "/" in g else "**/" + g)
        self.includes, self.excludes = [deep(g) for g in includes], [deep(g) for g in excludes]

    def match(self, name: str, is_dir: bool) -> bool:
        n = name + "/" if is_dir else name
        if any(g.search(n) for g in self.excludes):
            return False
        return is_dir or not self.includes or any(g.search(n) for g in self.includes)


@dataclass(frozen=True)
class _Rule:
    base: str
    glob: re.Pattern
    negated: bool
    dirs_only: bool

    def fits(self, name: str, is_dir: bool) -> bool:
        if self.base:
            if not name.startswith(self.base + "/"):
                return False
            name = name[len(self.base) + 1 :]
        return (is_dir or not self.dirs_only) and bool(self.glob.search(name))


def read_ignore_file(path: str, base: str) -> list[_Rule]:
    try:
        with open(path, encoding="utf-8", errors="surrogateescape", newline="") as f:
            lines = f.read().split("\n")
    except FileNotFoundError:
        return []
    rules = []
    for raw in lines:
        line = raw.removesuffix("\r")
        if not line or line.startswith("#"):
            continue
        escaped = line.startswith((r"\#", r"\!"))
        negated = not escaped and line.startswith("!")
        line = line[1:] if escaped or negated else line
        dirs_only = line.endswith("/")
        line = line.removesuffix("/")
        anchored = line.startswith("/")
        line = line.removeprefix("/")
        if not line:
            continue
        try:
            glob = compile_glob(line if anchored or "/" in line else "**/" + line)
        except ValueError as e:
            raise ValueError(f"{path}: invalid pattern {raw!r}: {e}") from e
        rules.append(_Rule(base, glob, negated, dirs_only))
    return rules


def _ignored(name: str, is_dir: bool, rules: list[_Rule]) -> bool:
    out = False
    for r in rules:  # the last that fits decides
        if r.fits(name, is_dir):
            out = not r.negated
    return out


def _walk(root: str, no_ignore: bool, filters: Filters, errors: list[str]) -> list[str]:
    files: list[str] = []

    def enter(folder: str, rel: str, rules: list[_Rule]) -> None:
        if not no_ignore:
            try:
                rules = rules + read_ignore_file(os.path.join(folder, ".gitignore"), rel)
            except (OSError, ValueError) as e:
                errors.append(str(e))
        try:
            names = sorted(os.listdir(folder), key=os.fsencode)
        except OSError as e:
            errors.append(f"{folder}: {e.strerror}")
            return
        for n in names:
            path, r = os.path.join(folder, n), f"{rel}/{n}" if rel else n
            try:
                mode = os.lstat(path).st_mode
            except OSError as e:
                errors.append(f"{path}: {e.strerror}")
                continue
            is_dir = stat.S_ISDIR(mode)
            if (is_dir and n == ".git") or _ignored(r, is_dir, rules) or not filters.match(r, is_dir):
                continue
            if is_dir:
                enter(path, r, rules)
            elif stat.S_ISREG(mode):
                files.append(path)

    enter(root, "", [])
    return files


def collect(paths: list[str], recursive: bool = False, no_ignore: bool = False, includes: list[str] = (), excludes: list[str] = ()) -> tuple[list[str], list[str]]:
    """(files, errors): arguments in their order, directories in byte order, each file once."""
    filters, seen, errors = Filters(includes, excludes), {}, []
    for p in paths:
        try:
            mode = os.stat(p).st_mode
        except OSError as e:
            errors.append(f"{p}: {e.strerror}")
            continue
        if stat.S_ISDIR(mode):
            if not recursive:
                errors.append(f"{p}: is a directory (use --recursive)")
                continue
            found = _walk(p, no_ignore, filters, errors)
        else:
            found = [p] if filters.match(os.path.basename(p), False) else []
        for f in found:
            seen.setdefault(os.path.normpath(f))
    return list(seen), errors


STDIN = "(standard input)"


def discover(paths: list[str], recursive: bool = False, **options) -> tuple[list[tuple[str | None, str]], list[str]]:
    """([(path or None for standard input, label)], errors); without arguments ``.`` if recursive, else standard input."""
    if not paths:
        paths = ["."] if recursive else ["-"]
    out: dict[tuple[str | None, str], None] = {}
    errors: list[str] = []
    for p in paths:
        if p == "-":
            out.setdefault((None, STDIN))
            continue
        files, bad = collect([p], recursive, **options)
        errors += bad
        for f in files:
            out.setdefault((f, f))
    return list(out), errors
