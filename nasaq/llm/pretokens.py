"""Pre-tokens of many texts at once with numpy, and a compact memory of what they are encoded as.

Texts are joined and seen as code points.  Where one pre-token ends and the
next begins follows from the classes of neighbouring code points (letter,
number, white space, other), so whole batches are cut in a few array passes.
A pre-token is named by two independent 64-bit multilinear hashes over its code
points, 128 bits in all; long ones are looked up as strings.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

from .words import mix

U = np.uint64
#: Code points of a pre-token that is hashed; longer ones are looked up as strings.
HASHED = 64
_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
#: The one pattern whose boundaries are computed here; others are matched by the regex module.
KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def pre_tokens(text: str, split: regex.Pattern, special: regex.Pattern | None) -> list[str]:
    """One text's pre-tokens; special tokens go first."""
    if special is None or not special.search(text):
        return split.findall(text)
    out: list[str] = []
    for i, part in enumerate(special.split(text)):
        out += [part] if i % 2 else split.findall(part)
    return out


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point, by the regex module's character database."""
    out = np.full(0x110000, _OTHER, np.uint8)
    at = np.concatenate([np.arange(0xD800, dtype="<u4"), np.arange(0xE000, 0x110000, dtype="<u4")])
    every = at.tobytes().decode("utf-32-le")
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[at[m.start() : m.end()]] = kind
    return out


@lru_cache(1)
def _weights() -> tuple[np.ndarray, np.ndarray]:
    """Fixed odd random weights of the places in a pre-token, for each of both hashes."""
    w = mix(np.arange(1, 2 * HASHED + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
    return w[:HASHED], w[HASHED:]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def known_starts(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of KNOWN begin; ``first`` are the places where a (non-empty) text begins."""
    n = len(x)
    c = _classes()[x]
    head = np.zeros(n + 1, bool)
    head[first] = head[n] = True
    space = c == _SPACE
    begin = np.ones(n, bool)
    begin[1:] = c[1:] != c[:-1]
    begin |= head[:-1]
    # a blank before anything but white space belongs to what follows
    joins = np.zeros(n, bool)
    joins[1:] = (x[:-1] == 0x20) & ~space[1:] & ~head[1:-1]
    begin &= ~joins
    # the last of a run of white space that something follows is apart from the rest
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~head[1:-1]
    begin |= last
    # contractions: an apostrophe that begins a pre-token, and the letters after it
    at = np.flatnonzero((x == 0x27) & begin)
    if len(at):
        pad = np.append(x, np.zeros(3, x.dtype))
        inside = ~head[np.minimum(at + 1, n)]
        a, b = pad[at + 1], np.where(head[np.minimum(at + 2, n)], 0, pad[at + 2])
        one = inside & np.isin(a, [ord(k) for k in "stmd"])
        two = inside & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        begin[at[one | two] + 1] = False
        for ends in (at[one] + 2, at[two] + 3):
            begin[ends[ends < n]] = True
    return np.flatnonzero(begin)


#: Characters of a text that are cut into pre-tokens at once, and of several texts together.
SLICE = 1 << 18
_SAFE = regex.compile(r"(?<=\p{L}) (?=\p{L})")


class Cutter:
    """Cuts texts into pre-tokens; special tokens go first and are pre-tokens themselves."""

    def __init__(self, split: str, special: list[str]):
        self.known = split == KNOWN
        self.find, self.special = regex.compile(split), special
        self.first = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def pieces(self, text: str) -> list[str]:
        """A long text cut where a blank between letters begins a pre-token anyway; others as they are."""
        if len(text) <= SLICE or not self.known:
            return [text]
        out, at = [], 0
        while at < len(text):
            m = _SAFE.search(text, at + SLICE) if len(text) - at > SLICE else None
            end = m.start() if m else len(text)
            out.append(text[at:end])
            at = end
        return out

    def _slow(self, text: str) -> np.ndarray:
        own = pre_tokens(text, self.find, self.first)
        n = [len(w) for w in own if w]
        if sum(n) != len(text):
            raise ValueError("the pattern of pre-tokens leaves out text")
        return np.cumsum([0, *n])[:-1]

    def cut(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """(joined, its code points, where each pre-token begins, and how many each text has)."""
        joined = "".join(texts)
        x = code_points(joined)
        size = np.array([len(t) for t in texts], np.int64)
        offset = np.cumsum(size) - size
        starts = known_starts(x, offset[size > 0]) if self.known and len(x) else np.zeros(0, np.int64)
        odd = range(len(texts)) if not self.known else [i for i, t in enumerate(texts) if any(s in t for s in self.special)] if any(s in joined for s in self.special) else ()
        if odd:
            keep, more = np.ones(len(starts), bool), []
            for i in odd:
                a, b = np.searchsorted(starts, [offset[i], offset[i] + size[i]])
                keep[a:b] = False
                more.append(self._slow(texts[i]) + offset[i])
            starts = np.sort(np.concatenate([starts[keep], *more]))
        count = np.searchsorted(starts, offset + size) - np.searchsorted(starts, offset)
        return joined, x, starts.astype(np.int64), count


def hashes(x: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each pre-token of at most HASHED code points (of a longer one: of nothing in particular)."""
    if not len(starts):
        return np.zeros(0, U), np.zeros(0, U)
    place = np.arange(len(x), dtype=np.int32) - np.repeat(starts.astype(np.int32), size)
    np.minimum(place, HASHED - 1, out=place)
    v, salt = x.astype(U) + U(1), size.astype(U)
    out = []
    for w in _weights():
        out.append(mix(np.add.reduceat(v * w[place], starts) + salt * U(0xD6E8FEB86659FD93)))
    return out[0], out[1]


class Memory:
    """Pre-token -> ids, as arrays: an open-addressed table over the hashes and one flat array of ids.

    ``ask`` gives the ids of pre-tokens that are not known yet.  Beyond ``most``
    entries, or ids, those of more than one id are forgotten.
    """

    def __init__(self, cutter: Cutter, ask: Callable[[list[str]], list[np.ndarray]], kind: np.dtype, most: int):
        self.cutter, self.ask, self.kind, self.most = cutter, ask, np.dtype(kind), most
        self.mask = (1 << max(8, (2 * most).bit_length())) - 1
        self._reset()

    def _reset(self) -> None:
        self.slots = np.full(self.mask + 1, -1, np.int32)
        self.n = self.n_ids = 0
        self.k1, self.k2 = np.zeros(1024, U), np.zeros(1024, U)
        self.start, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.flat = np.zeros(4096, self.kind)
        self.long: dict[str, int] = {}

    def _grow(self, entries: int, ids: int) -> None:
        for names, want in ((("k1", "k2", "start", "size"), self.n + entries), (("flat",), self.n_ids + ids)):
            for name in names:
                old = getattr(self, name)
                if want > len(old):
                    new = np.zeros(max(want, 2 * len(old)), old.dtype)
                    new[: len(old)] = old
                    setattr(self, name, new)

    def _append(self, k1: np.ndarray, k2: np.ndarray, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        m = len(size)
        self._grow(m, len(ids))
        new = np.arange(self.n, self.n + m)
        self.k1[new], self.k2[new], self.size[new] = k1, k2, size
        self.start[new] = self.n_ids + np.cumsum(size) - size
        self.flat[self.n_ids : self.n_ids + len(ids)] = ids
        self.n, self.n_ids = self.n + m, self.n_ids + len(ids)
        return new

    def _place(self, entries: np.ndarray) -> None:
        at = (self.k1[entries] & U(self.mask)).astype(np.int64)
        while len(entries):
            free = self.slots[at] < 0
            self.slots[at[free]] = entries[free]
            lost = self.slots[at] != entries
            entries, at = entries[lost], (at[lost] + 1) & self.mask

    def _lookup(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Entry of each pair of hashes, -1 where there is none."""
        at = (h1 & U(self.mask)).astype(np.int64)
        found = self.slots[at].astype(np.int64)
        todo = np.flatnonzero((found >= 0) & ((self.k1[found] != h1) | (self.k2[found] != h2)))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            e = found[todo] = self.slots[at[todo]]
            todo = todo[(e >= 0) & ((self.k1[e] != h1[todo]) | (self.k2[e] != h2[todo]))]
        return found

    def _forget(self) -> None:
        """Only entries of one id stay."""
        own = np.flatnonzero((self.size[: self.n] == 1) & (self.k1[: self.n] != 0))[: self.most // 2]
        k1, k2, ids = self.k1[own], self.k2[own], self.flat[self.start[own]]
        self._reset()
        self._place(self._append(k1, k2, ids, np.ones(len(own), np.int32)))

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each text has), whole texts in order; ``end`` is appended to each."""
        ids, count, batch, size = [], [], [], 0
        for t in texts:
            if batch and size + len(t) > SLICE:
                self._add(batch, end, ids, count)
                batch, size = [], 0
            pieces = self.cutter.pieces(t) if len(t) > SLICE and not any(x in t for x in self.cutter.special) else [t]
            if len(pieces) > 1:
                before = sum(map(len, ids))
                for p in pieces[:-1]:
                    self._add([p], None, ids, [])
                self._add(pieces[-1:], end, ids, [])
                count.append(np.array([sum(map(len, ids)) - before]))
            else:
                batch.append(t)
                size += len(t)
        if batch:
            self._add(batch, end, ids, count)
        none = np.zeros(0, self.kind), np.zeros(0, np.int64)
        return (np.concatenate(ids), np.concatenate(count)) if count else none

    def _add(self, texts: list[str], end: int | None, ids: list, count: list) -> None:
        x, n = self._encode(texts, end)
        ids.append(x)
        count.append(n)

    def _encode(self, texts: list[str], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        if self.n > self.most or self.n_ids > 8 * self.most:
            self._forget()
        joined, x, starts, count = self.cutter.cut(texts)
        size = np.diff(np.append(starts, len(x)))
        h1, h2 = hashes(x, starts, size)
        entry = self._lookup(h1, h2) if len(starts) else np.zeros(0, np.int64)
        for i in np.flatnonzero(size > HASHED).tolist():
            word = joined[starts[i] : starts[i] + size[i]]
            if word not in self.long:
                ids = self.ask([word])[0]
                zero = np.zeros(1, U)
                self.long[word] = int(self._append(zero, zero, ids, np.array([len(ids)], np.int32))[0])
            entry[i] = self.long[word]
        while len(missing := np.flatnonzero(entry < 0)):
            _, one = np.unique(h1[missing], return_index=True)
            one = missing[one]
            ids = self.ask([joined[a : a + n] for a, n in zip(starts[one].tolist(), size[one].tolist())])
            n = np.array([len(i) for i in ids], np.int32)
            self._place(self._append(h1[one], h2[one], np.concatenate(ids), n))
            entry[missing] = self._lookup(h1[missing], h2[missing])
        if end is not None:
            e = self._append(np.zeros(1, U), np.zeros(1, U), np.array([end], self.kind), np.ones(1, np.int32))
            entry = np.insert(entry, np.cumsum(count), e[0])
            count = count + 1
        n = self.size[entry].astype(np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.start[entry] - (ends - n), n) + np.arange(total)]
        upto = np.concatenate([[0], ends])[np.cumsum(count)]
        return ids, np.diff(upto, prepend=0)
