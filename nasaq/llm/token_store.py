"""Token ids in wavelet-matrix shards.

A shard's bytes hold one wavelet matrix: a bit-plane per bit of the id, high
bit first, each followed by the stable partition of the sequence by that bit.
The planes are cut into blocks that are compressed apart, with the ones before
each block beside them, so one compressed file answers access (the id at a
place), rank (how often an id occurs before a place) and select (where its k-th
occurrence lies) by unpacking a block a step, and gives back the whole sequence.

Shards are written in ascending document order through Spark's own committer,
each shard's bytes in one row, so that any store Spark can write will do and a
lost executor's shards are written again.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import pattern, vocabulary_path
from .frames import _STAGED, pick, shared_dir
from .pretokens import KNOWN, Cutter, Memory
from .token_counts import VOCABULARY, library, special_tokens

MAGIC = b"NWM2"
END = 0
#: Ids in one shard, at least; a shard ends with the document that reaches it.
SHARD = 2_000_000
#: Bits of a block of a plane: blocks are compressed apart, with the ones before each in the directory.
BLOCK = 1 << 17
#: Blocks that an open shard keeps unpacked.
OPEN_BLOCKS = 256
#: Resolved pre-tokens that a worker remembers; then it forgets those of more than one id.
MEMORY = 1_000_000
#: Texts that are cut into pre-tokens at once.
TEXTS = 256
#: Pre-tokens in one call's text; the library cuts them apart again.
PACK = 200
_SCHEMA = "part int, seq int, first_doc long, n_docs long, n_ids long, data binary"


def build(ids: np.ndarray, levels: int | None = None) -> list[tuple[np.ndarray, int]]:
    """Bit-planes (packed) with their count of zeros, high bit first."""
    x = np.ascontiguousarray(ids, np.uint32 if len(ids) and int(ids.max()) > 0xFFFF else np.uint16)
    levels = levels or max(1, int(x.max()).bit_length() if len(x) else 1)
    planes = []
    for b in range(levels - 1, -1, -1):
        bit = (x & x.dtype.type(1 << b)).astype(bool)
        low = x[~bit]
        planes.append((np.packbits(bit, bitorder="little"), len(low)))
        if b:  # the last partition is not needed
            x = np.concatenate([low, x[bit]])
    return planes


def write_shard(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard file: header, directory, then document ids, lengths and the blocks of the bit-planes, each compressed apart.

    The directory holds each level's zeros, the ones before each block (uint32
    counts per 128 Ki bits, 0.02 % of the planes) and the blobs' sizes, so a
    place is reached by unpacking one block a level.
    """
    planes = build(ids)
    c = zstandard.ZstdCompressor(level=1)
    packed = [c.compress(np.asarray(x, "<i8").tobytes()) for x in (doc_ids, lengths)]
    ranks = []
    for p, _ in planes:
        blocks = [p[s : s + BLOCK // 8] for s in range(0, len(p), BLOCK // 8)]
        ranks.append(np.cumsum([0] + [int(np.bitwise_count(x).sum(dtype=np.int64)) for x in blocks]))
        packed += [c.compress(x.tobytes()) for x in blocks]
    head = struct.pack("<4sIQQ", MAGIC, len(planes), len(doc_ids), len(ids)) + b"".join(struct.pack("<Q", z) for _, z in planes)
    return head + b"".join(r.astype("<u4").tobytes() for r in ranks) + np.array([len(p) for p in packed], "<u4").tobytes() + b"".join(packed)


class Shard:
    """A shard file opened for reading; blocks are unpacked as they are asked for, and few are kept."""

    def __init__(self, data: bytes):
        magic, levels, self.n_docs, self.n = struct.unpack_from("<4sIQQ", data)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        self._data = memoryview(data)
        self.levels, self.blocks = levels, -(-self.n // BLOCK)
        self.zeros = list(struct.unpack_from(f"<{levels}Q", data, 24))
        at = 24 + 8 * levels
        self._before = np.frombuffer(data, "<u4", levels * (self.blocks + 1), at).reshape(levels, -1)
        at += 4 * self._before.size
        sizes = np.frombuffer(data, "<u4", 2 + levels * self.blocks, at).astype(np.int64)
        self._at = at + 4 * len(sizes) + np.concatenate([[0], np.cumsum(sizes)])
        self.doc_ids, self.lengths = (np.frombuffer(self._blob(i), "<i8") for i in range(2))
        self._open: OrderedDict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = OrderedDict()

    def _blob(self, i: int) -> bytes:
        return zstandard.decompress(self._data[self._at[i] : self._at[i + 1]])

    def _block(self, level: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's bytes, and the ones before each 64 bytes of it."""
        key = (level, block)
        if key in self._open:
            self._open.move_to_end(key)
        else:
            p = np.frombuffer(self._blob(2 + level * self.blocks + block), np.uint8)
            ones = np.add.reduceat(np.bitwise_count(p), np.arange(0, len(p), 64), dtype=np.int64)
            self._open[key] = p, np.concatenate([[0], np.cumsum(ones)])
            if len(self._open) > OPEN_BLOCKS:
                self._open.popitem(last=False)
        return self._open[key]

    def plane(self, level: int) -> np.ndarray:
        """A whole bit-plane, packed."""
        return np.frombuffer(b"".join(self._blob(2 + level * self.blocks + k) for k in range(self.blocks)), np.uint8)

    def _bits(self, level: int, i) -> tuple[np.ndarray, np.ndarray]:
        """(the bit at place i, the ones before it); i = n has no bit."""
        i = np.asarray(i, np.int64)
        bit, ones = np.zeros(i.shape, np.int64), np.full(i.shape, int(self._before[level][-1]), np.int64)
        block = i // BLOCK
        for k in np.unique(block[i < self.n]).tolist():
            own = (block == k) & (i < self.n)
            p, every64 = self._block(level, k)
            j = i[own] - k * BLOCK
            byte, part = j >> 3, j >> 9
            window = (part[:, None] << 6) + np.arange(64)
            seen = np.bitwise_count(p[np.minimum(window, len(p) - 1)]) * (window < byte[:, None])
            tail = np.bitwise_count(p[byte] & ((1 << (j & 7)) - 1).astype(np.uint8))
            bit[own] = p[byte] >> (j & 7).astype(np.uint8) & 1
            ones[own] = int(self._before[level][k]) + every64[part] + seen.sum(1, dtype=np.int64) + tail
        return bit, ones

    def _rank1(self, level: int, i):
        """Ones of a plane before place i (vectorised over i)."""
        return self._bits(level, i)[1]

    def access(self, i):
        """The ids at places i."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        if len(i) and (i.min() < 0 or i.max() >= self.n):
            raise IndexError("place outside the shard")
        v = np.zeros(len(i), np.int64)
        for k in range(self.levels):
            bit, r = self._bits(k, i)
            i = np.where(bit == 1, self.zeros[k] + r, i - r)
            v = v << 1 | bit
        return v

    def rank(self, symbol: int, i: int) -> int:
        """How often ``symbol`` occurs before place i."""
        if symbol < 0 or symbol >> self.levels:
            return 0
        a, b = 0, min(max(i, 0), self.n)
        for k in range(self.levels):
            ra, rb = (int(x) for x in self._rank1(k, [a, b]))
            if symbol >> (self.levels - 1 - k) & 1:
                a, b = self.zeros[k] + ra, self.zeros[k] + rb
            else:
                a, b = a - ra, b - rb
        return b - a

    def select(self, symbol: int, k: int) -> int:
        """The place of the k-th occurrence (from 0) of ``symbol``; -1 if there are fewer."""
        if k < 0 or k >= self.rank(symbol, self.n):
            return -1
        a = 0
        for l in range(self.levels):
            r = int(self._rank1(l, a))
            a = self.zeros[l] + r if symbol >> (self.levels - 1 - l) & 1 else a - r
        at = a + k
        for l in range(self.levels - 1, -1, -1):
            one = symbol >> (self.levels - 1 - l) & 1
            want = at - self.zeros[l] if one else at
            lo, hi = 0, self.n  # first place with rank > want, less one
            while lo < hi:
                mid = (lo + hi) // 2
                r = int(self._rank1(l, mid + 1))
                if (r if one else mid + 1 - r) > want:
                    hi = mid
                else:
                    lo = mid + 1
            at = lo
        return at

    def sequence(self) -> np.ndarray:
        """All ids in order: the stable partitions undone from the last plane up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        v = np.zeros(self.n, kind)
        for k in range(self.levels - 1, -1, -1):
            bit = np.unpackbits(self.plane(k), count=self.n, bitorder="little").view(bool)
            z = self.zeros[k]
            up = np.empty(self.n, kind)
            up[~bit] = v[:z]
            up[bit] = v[z:] | kind(1 << (self.levels - 1 - k))
            v = up
        return v


class _Library:
    """Ids by the tokenizers library, asked once a distinct pre-token while it is remembered."""

    def __init__(self, path: str, split: str):
        self.t = library(path)
        self.kind = np.dtype("<u2" if self.t.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        special = special_tokens(path)
        # a space and letters: such pre-tokens in a row are cut apart again, as no special token has a space
        self.packs = split == KNOWN and not any(any(c.isspace() for c in x) for x in special)
        self.memory = Memory(Cutter(split, special), self._ask, self.kind, MEMORY)

    def _single(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.t.encode_batch_fast(words, add_special_tokens=False)]

    def _packed(self, words: list[str]) -> list[np.ndarray]:
        out = []
        packs = [words[s : s + PACK] for s in range(0, len(words), PACK)]
        for own, e in zip(packs, self.t.encode_batch(["".join(p) for p in packs], add_special_tokens=False)):
            cut = np.flatnonzero(np.diff(np.array(e.word_ids, np.int64))) + 1
            out += np.split(np.array(e.ids, self.kind), cut) if len(cut) == len(own) - 1 else self._single(own)
        return out

    def _ask(self, words: list[str]) -> list[np.ndarray]:
        packs = [self.packs and w[0] == " " and w[1:].isalpha() for w in words]
        packed = iter(self._packed([w for w, p in zip(words, packs) if p]))
        single = iter(self._single([w for w, p in zip(words, packs) if not p]))
        return [next(packed if p else single) for p in packs]

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each text has); ``end`` is appended to each text."""
        return self.memory.encode(texts, end)


_libraries: dict[tuple[str, str], _Library] = {}


def _shards(batches: Iterator[pa.RecordBatch], path: str, split: str, shard: int) -> Iterator[pa.RecordBatch]:
    if (path, split) not in _libraries:
        _libraries[path, split] = _Library(path, split)
    e = _libraries[path, split]
    part, seq = TaskContext.get().partitionId(), 0
    docs, lens, parts, n = [], [], [], 0

    def flush() -> pa.RecordBatch:
        own = np.concatenate(docs)
        data = write_shard(own, np.concatenate(lens), np.concatenate(parts))
        cols = [[part], [seq], [int(own[0])], [len(own)], [n], [data]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["part", "seq", "first_doc", "n_docs", "n_ids", "data"])

    for b in batches:
        for s in range(0, b.num_rows, TEXTS):
            own, texts = np.asarray(b.column(0)[s : s + TEXTS]), b.column(1)[s : s + TEXTS].to_pylist()
            ids, count = e.encode([t or "" for t in texts], END)
            ends, at, done = np.cumsum(count), 0, 0
            while at < len(own):  # up to the document that fills the shard
                to = min(int(np.searchsorted(ends, done + shard - n)) + 1, len(own))
                docs.append(own[at:to])
                lens.append(count[at:to])
                parts.append(ids[done : int(ends[to - 1])])
                n += len(parts[-1])
                at, done = to, int(ends[to - 1])
                if n >= shard:
                    yield flush()
                    seq += 1
                    docs, lens, parts, n = [], [], [], 0
    if docs:
        yield flush()


def write(docs: DataFrame, where: str, path: str | None = None, split: str | None = None, shard: int = SHARD) -> None:
    """Encode every whole text, append the end id and write shards in ascending doc_id order to ``where``.

    Null texts are empty: the end id alone.  Rows with a null doc_id have no
    place in the order and are left out.  Repeated doc_ids follow each other,
    by their texts' hashes, and may lie in several ranges.
    """
    path, split = path or vocabulary_path(VOCABULARY), split or pattern()
    d = pick(docs, "doc_id", "text").where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long"))
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.select("doc_id", "text", F.xxhash64("text").alias("h"))
    ordered = d.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    ordered.mapInArrow(lambda it: _shards(it, path, split, shard), _SCHEMA).write.mode("overwrite").option("compression", "none").parquet(where)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            s = Shard(r["data"])
            x = s.sequence().astype("<u4")
            ends = np.cumsum(s.lengths)
            crc = [zlib.crc32(x[e - k : e]) for e, k in zip(ends.tolist(), s.lengths.tolist())]
            cols = [pa.array(s.doc_ids), pa.array(ends - s.lengths + r["before"]), pa.array(s.lengths), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, where: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the shards alone.

    Only the shards' sizes are put in order, in two levels: partitions, and
    shards inside a partition; the ids stay where they are.
    """
    from pyspark.sql import Window

    files = spark.read.schema(_SCHEMA).parquet(where)
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    # one row per written partition: their number follows the shuffle partitions, not the documents
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part", F.coalesce(F.sum("ids").over(w), F.lit(0)).alias("base"))
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    local = files.select("part", "seq", "n_ids").select("part", "seq", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)).alias("inside"))
    at = local.join(before, "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("before"))
    return files.join(at, ["part", "seq"]).select("data", "before").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store(docs: DataFrame, path: str | None = None, split: str | None = None, where: str | None = None) -> DataFrame:
    """Write the shards (to the shared folder unless ``where`` says otherwise) and read them back."""
    spark = docs.sparkSession
    if where is None:
        where = f"{shared_dir(spark)}/nasaq/tokens-{uuid.uuid4().hex}"
        _STAGED.append((spark, where))
    write(docs, where, path, split)
    return read(spark, where)
