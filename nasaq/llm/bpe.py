"""Byte-level BPE encoding and decoding.

A pre-token is looked up in two tiers.  A minimal perfect hash over the
vocabulary resolves it when it is a token itself; a miss is merged with a heap
of pair ranks over doubly linked bytes.  Pre-tokens repeat, so each worker
keeps a bounded memory of resolved ones (``pretokens``).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .frames import add_columns, pick, unclash
from .pretokens import Cutter, Memory

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Resolved pre-tokens that a worker remembers; then it forgets those of more than one id.
MEMORY = 1_000_000
#: Texts that are encoded at once.
TEXTS = 256


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash of byte strings: hash, displace, compare.

    Buckets are placed largest first; each stores the displacement that sends
    its keys to free slots, and n keys fill n slots.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        n = self.n = len(keys)
        self.m = max(1, n // 3)
        slots = np.full(max(n, 1), -1, np.int64)
        h = [self._hash(k) for k in keys]
        buckets: dict[int, list[int]] = {}
        for i, (b, _, _) in enumerate(h):
            buckets.setdefault(b, []).append(i)
        self.shift = [0] * self.m
        free = None
        for b, own in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(own) == 1:  # any free slot: stored directly
                if free is None:
                    free = iter(np.flatnonzero(slots < 0).tolist())
                s = next(free)
                slots[s], self.shift[b] = own[0], -1 - s
                continue
            d = 0
            while True:
                at = {(h[i][1] + d * h[i][2]) % n for i in own}
                if len(at) == len(own) and all(slots[a] < 0 for a in at):
                    break
                d += 1
            for i in own:
                slots[(h[i][1] + d * h[i][2]) % n] = i
            self.shift[b] = d
        order = slots.tolist() if n else []
        self.keys = [keys[i] for i in order]
        self.values = [values[i] for i in order]

    def _hash(self, key: bytes) -> tuple[int, int, int]:
        x = xxhash.xxh3_128_intdigest(key)
        return (x & 0xFFFFFFFF) % self.m, x >> 32 & 0xFFFFFFFF, (x >> 64 & 0xFFFFFFFF) | 1

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        b, h1, h2 = self._hash(key)
        d = self.shift[b]
        s = -1 - d if d < 0 else (h1 + d * h2) % self.n
        return self.values[s] if self.keys[s] == key else None


def merge_bytes(b: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: lowest pair rank first, leftmost of equals, by a heap over linked bytes."""
    n = len(b)
    bits = n.bit_length()
    low = (1 << bits) - 1
    get = ranks.get
    nxt = list(range(1, n + 2))  # where the part that begins here ends
    prv = list(range(-1, n))
    alive = bytearray(b"\1") * (n + 1)
    heap = [(r << bits | i) << bits | (i + 2) for i in range(n - 1) if (r := get(b[i : i + 2])) is not None]
    heapq.heapify(heap)
    push, pop = heapq.heappush, heapq.heappop
    while heap:
        x = pop(heap)
        e, i = x & low, x >> bits & low
        m = nxt[i]
        if not alive[i] or m >= n or nxt[m] != e:
            continue
        alive[m] = 0
        nxt[i] = e
        if e < n:
            prv[e] = i
            f = nxt[e]
            if (r := get(b[i:f])) is not None:
                push(heap, (r << bits | i) << bits | f)
        p = prv[i]
        if p >= 0 and (r := get(b[p:e])) is not None:
            push(heap, (r << bits | p) << bits | e)
    out, i = [], 0
    while i < n:
        out.append(ranks[b[i : nxt[i]]])
        i = nxt[i]
    return out


class Encoder:
    """Ids of whole texts; each distinct pre-token is resolved in two tiers while it is remembered."""

    def __init__(self, path: str, split: str):
        self.ranks = load_ranks(path)
        self.perfect = PerfectHash(list(self.ranks), list(self.ranks.values()))
        self.pieces = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for k, v in self.ranks.items():
            self.pieces[v] = k
        self.memory = Memory(Cutter(split, []), self._resolve, np.dtype("<u4"), MEMORY)

    def _resolve(self, words: list[str]) -> list[np.ndarray]:
        out = []
        for w in words:
            b = w.encode("utf-8")
            i = self.perfect.get(b)
            out.append(np.array([i] if i is not None else merge_bytes(b, self.ranks), "<u4"))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each text has) of whole texts."""
        return self.memory.encode(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


@lru_cache(2)
def encoder(path: str, split: str) -> Encoder:
    """One encoder per worker process; the tables are of the vocabulary's size."""
    return Encoder(path, split)


def encode(docs: DataFrame, path: str | None = None, split: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array<int>) of each whole text; a null text has no ids.

    Narrow: no shuffle.  Special tokens are ordinary text.  Empty texts give an
    empty array, repeated rows are encoded each, other columns stay, but
    for those whose names clash.
    """
    path, split = path or vocabulary_path(), split or pattern()

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        e = encoder(path, split)
        ids, n = e.encode([t or "" for t in b.column(0).to_pylist()])
        off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(off), pa.array(ids.astype(np.int32)))]

    return add_columns(unclash(docs, ["text"], ["ids"]), [T.StructField("ids", T.ArrayType(T.IntegerType()))], make, ["text"])


def decode(rows: DataFrame, path: str | None = None, split: str | None = None) -> DataFrame:
    """``rows`` with ``decoded`` (binary) from their column ``ids`` (array<int>); null ids give empty bytes."""
    path, split = path or vocabulary_path(), split or pattern()

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        e = encoder(path, split)
        return [pa.array([e.decode(np.array(x or [], "<u4")) for x in b.column(0).to_pylist()], pa.binary())]

    return add_columns(unclash(rows, ["ids"], ["decoded"]), [T.StructField("decoded", T.BinaryType())], make, ["ids"])


def round_trip(docs: DataFrame, path: str | None = None, split: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each text, encoded and decoded from its ids.

    The digests are made where the ids are, so no row carries a text's ids.
    """
    path, split = path or vocabulary_path(), split or pattern()

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        e = encoder(path, split)
        n, a, d = [], [], []
        for s in range(0, b.num_rows, TEXTS):
            every, count = e.encode([t or "" for t in b.column(0)[s : s + TEXTS].to_pylist()])
            n += count.tolist()
            for end, k in zip(np.cumsum(count).tolist(), count.tolist()):
                ids = every[end - k : end]
                a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                d.append(hashlib.sha256(e.decode(ids)).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return add_columns(pick(docs, "doc_id", "text"), fields, make, ["text"]).drop("text")
