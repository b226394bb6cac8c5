"""Token counts without ids: pieces are counted once per distinct pre-token.

Documents become chunks of a bounded size.  A chunk holds each document's
pre-token frequencies as a sparse matrix over the chunk's distinct pre-tokens.
The distinct pre-tokens go to the bucket of their hash, are counted there once
with the tokenizer library, and the counts come back to the chunk, where a
matrix-vector product sums them.  Both relations travel packed, so the shuffle
is a fraction of the text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import pattern, vocabulary_path
from .frames import pick
from .pretokens import pre_tokens

VOCABULARY = "byte_bpe_50k.json"
#: Text in one chunk, in characters; a longer document is a chunk of its own.
CHUNK = 16 << 20
#: Counted pre-tokens that a worker remembers; then it starts afresh.
MEMORY = 200_000
_SCHEMA = "key long, chunk long, part int, words binary, doc_ids binary, known binary, matrix binary"
_NAMES = ["key", "chunk", "part", "words", "doc_ids", "known", "matrix"]
_TYPES = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]


@lru_cache(2)
def library(path: str):
    """The library's tokenizer, without threads of its own: a task has one core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def special_tokens(path: str) -> list[str]:
    """Strings that the library takes for one token inside a text."""
    return sorted((t.content for t in library(path).get_added_tokens_decoder().values()), key=len, reverse=True)


def splitter(path: str, split: str) -> tuple[regex.Pattern, regex.Pattern | None]:
    """The pattern of pre-tokens, and that of special tokens, which go first."""
    special = special_tokens(path)
    return regex.compile(split), regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 3)


def _unpack(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def _row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _TYPES)], names=_NAMES)


def _chunks(batches: Iterator[pa.RecordBatch], path: str, split: str, buckets: int) -> Iterator[pa.RecordBatch]:
    find, special = splitter(path, split)
    chunk = TaskContext.get().partitionId() << 32

    def flush():
        words = list(local)
        # where each word is counted: a function of the word alone
        where = np.fromiter((hash_of(w) for w in words), np.int64, len(words)) % buckets
        order = np.argsort(where, kind="stable")
        ends = np.searchsorted(where[order], np.arange(buckets + 1))
        new = np.empty(len(words), np.int32)
        new[order] = np.arange(len(words), dtype=np.int32)
        for b in np.flatnonzero(np.diff(ends)).tolist():
            blob = "\0".join([_escape(words[i]) for i in order[ends[b] : ends[b + 1]].tolist()])
            yield _row(b, chunk, b, zstandard.compress(blob.encode("utf-8"), 3), None, None, None)
        pieces = []
        for x in found:  # distinct words and their frequencies in one document
            u, c = np.unique(new[x], return_counts=True)
            pieces.append((len(u), u, c))
        rows = np.array([p[0] for p in pieces], "<i4")
        u = np.concatenate([np.diff(p[1], prepend=0) for p in pieces]).astype("<i4") if pieces else np.zeros(0, "<i4")
        c = np.concatenate([p[2] for p in pieces]).astype("<i4") if pieces else np.zeros(0, "<i4")
        matrix = _join(_pack(rows), _planes(u), _planes(c))
        yield _row(chunk, chunk, -1, None, _join(_pack(np.array([i or 0 for i in ids], "<i8")), _pack(np.array([i is None for i in ids], np.uint8))), _pack(np.array(sizes, "<i8")), matrix)

    local: dict[str, int] = {}
    found, ids, sizes, size = [], [], [], 0
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
            t = text.as_py() or ""
            if ids and size + len(t) > CHUNK:
                yield from flush()
                chunk += 1
                local, found, ids, sizes, size = {}, [], [], [], 0
            found.append(np.array([local.setdefault(w, len(local)) for w in pre_tokens(t, find, special)], np.int32))
            ids.append(doc)
            sizes.append(len(t.encode("utf-8")))
            size += len(t)
    if ids:
        yield from flush()


def _escape(word: str) -> str:
    return word.replace("\1", "\1o").replace("\0", "\1z") if "\0" in word or "\1" in word else word


def _join(*blobs: bytes) -> bytes:
    return b"".join(len(z).to_bytes(8, "little") + z for z in blobs)


def _parts(m: bytes) -> list[bytes]:
    out = []
    while m:
        k = int.from_bytes(m[:8], "little")
        out.append(m[8 : 8 + k])
        m = m[8 + k :]
    return out


def _planes(x: np.ndarray) -> bytes:
    """int32 values by byte plane, which packs small ones well."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _values(b: bytes) -> np.ndarray:
    p = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(p.T).view("<i4").ravel()


def hash_of(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word.encode("utf-8")) >> 1


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    t = library(path)
    known: dict[str, int] = {}
    for b in batches:
        for r in b.to_pylist():
            if r["words"] is not None:
                words = zstandard.decompress(r["words"]).decode("utf-8").split("\0")
                words = [w.replace("\1z", "\0").replace("\1o", "\1") if "\1" in w else w for w in words]
                if len(known) > MEMORY:
                    known.clear()
                new = [w for w in words if w not in known]
                for s in range(0, len(new), 20_000):
                    part = new[s : s + 20_000]
                    known.update(zip(part, map(len, t.encode_batch_fast(part, add_special_tokens=False))))
                r["words"] = _planes(np.array([known[w] for w in words], "<i4"))
            yield _row(r["chunk"], *(r[k] for k in _NAMES[1:]))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def _sum(table: pa.Table) -> pa.Table:
    rows = table.select(["part", "words", "doc_ids", "known", "matrix"]).to_pylist()
    own = next(r for r in rows if r["part"] < 0)
    counted = [_values(r["words"]) for r in sorted((r for r in rows if r["part"] >= 0), key=lambda r: r["part"])]
    n = np.concatenate(counted).astype(np.int64) if counted else np.zeros(0, np.int64)
    parts = _parts(own["matrix"])
    rows_n, step, freq = _unpack(parts[0], "<i4"), _values(parts[1]).astype(np.int64), _values(parts[2])
    ends = np.cumsum(rows_n, dtype=np.int64)
    total = np.cumsum(step)  # each document's indices begin at 0 again
    base = np.concatenate([[0], total])[ends - rows_n]
    col = total - np.repeat(base, rows_n)
    every = np.concatenate([[0], np.cumsum(n[col] * freq)])
    ids, null = _parts(own["doc_ids"])
    return pa.Table.from_arrays([pa.array(_unpack(ids, "<i8"), mask=_unpack(null, np.uint8).astype(bool)), pa.array(_unpack(own["known"], "<i8")), pa.array(every[ends] - every[ends - rows_n])], schema=_OUT)


def count_tokens(docs: DataFrame, path: str | None = None, split: str | None = None, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each whole text, as the tokenizers library counts.

    Null texts count as empty: 0 bytes, 0 tokens.  Repeated rows and null ids
    are counted each.  Special strings inside a text are one token.  A chunk is
    bounded by CHUNK, so no task holds more however large the corpus; hot
    pre-tokens arrive once per chunk.
    """
    path, split = path or vocabulary_path(VOCABULARY), split or pattern()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    packed = d.mapInArrow(lambda it: _chunks(it, path, split, n), _SCHEMA)
    counted = packed.repartition(n, "key").mapInArrow(lambda it: _count(it, path), _SCHEMA)
    out = counted.groupBy("chunk").applyInArrow(_sum, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
