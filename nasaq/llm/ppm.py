"""Language-model scoring by prediction by partial matching (PPM).

The model is a trie of byte contexts up to ORDER bytes.  A symbol is coded in
its longest known context or escapes to the next shorter one; escapes are
estimated by method D (half a count of each distinct symbol), and a symbol that
a longer context could have coded is excluded below it.

The trie is a set of Spark tables keyed by the bytes of context and symbol
packed in a long, so it grows with the corpus and is never gathered in one
place.  Documents lie in chunks; a chunk asks for its distinct (context,
symbol) pairs and words, and gets their code lengths back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import pick, stage
from .words import word_hashes

ORDER = 5
#: Text in one chunk, in bytes; a longer document is a chunk of its own.
CHUNK = 32 << 20
SLAB = 1 << 19
#: Text in one compressed batch of a chunk, in bytes.
PACKED = 4 << 20
END = b"\n"
_END_WORD = np.uint64(0x0E0D0C0B0A090807)
_SCHEMA = "chunk long, kind int, key long, n long, blob binary"


def normalise(text: str | None) -> bytes:
    """Words, A-Z lower-cased, one space between them, one end."""
    return b" ".join((text or "").encode("utf-8").lower().split()) + END


def _grams(seqs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(context, symbol) of each byte packed in a long, and each sequence's offsets.

    Before a sequence lie ORDER ends.
    """
    pad = END * ORDER
    x = np.frombuffer(pad + pad.join(seqs), np.uint8).astype(np.int64)
    g = x[ORDER:].copy()
    for j in range(1, ORDER + 1):
        g |= x[ORDER - j : len(x) - j] << (8 * j)
    length = np.array([len(s) for s in seqs], np.int64)
    keep = np.ones(len(g), bool)
    at = np.cumsum(length + ORDER) - ORDER  # where the next padding begins
    for j in range(ORDER):
        keep[at[:-1] + j] = False
    return g[keep], np.concatenate([[0], np.cumsum(length)])


def _word_keys(seqs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token, the end included, and each sequence's offsets."""
    x = np.frombuffer(b"".join(seqs), np.uint8)
    o = np.concatenate([[0], np.cumsum([len(s) for s in seqs])]).astype(np.int64)
    h, wo = word_hashes(x, o)
    return np.insert(h, wo[1:], _END_WORD).view(np.int64), wo + np.arange(len(wo))


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new)


def _fold(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in order, with the sums of their weights; empties ``parts`` to free what it has copied."""
    k, n = (np.concatenate(z) for z in zip(*parts))
    parts.clear()
    by = np.argsort(k)
    k, n = k[by], n[by]
    at = _runs(k)
    return k[at], np.add.reduceat(n, at) if len(at) else n


class _Counter:
    """Distinct keys with the sums of their weights, folded as they come."""

    def __init__(self):
        self.parts, self.rows, self.folded = [], 0, 0

    def add(self, keys: np.ndarray, weight: np.ndarray) -> None:
        self.parts.append((keys, weight))
        self.rows += len(keys)
        if self.rows > max(500_000, self.folded // 2):
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        whole = _fold(self.parts)
        self.parts, self.rows, self.folded = [whole], 0, len(whole[0])
        return whole


def _distinct_grams(grams: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and how many have weight 1 (not 0); both go through one sort, as a gram leaves bits free."""
    p = np.sort(grams << 1 | weight)
    k = p >> 1
    at = _runs(k)
    return k[at], np.add.reduceat(p & 1, at)


def _gram_sums(grams: np.ndarray, o: np.ndarray, keys: np.ndarray, vals: np.ndarray) -> np.ndarray:
    """For each sequence the sum of its grams' values; ``keys`` are sorted and have every gram.

    Grams are sorted with their sequence's number in the low 16 bits, so each
    distinct gram is looked up once, in order.
    """
    n = len(o) - 1
    seq = np.repeat(np.arange(n, dtype=np.uint64), np.diff(o))
    p = np.sort(grams.astype(np.uint64) << np.uint64(16) | seq)
    k = p >> np.uint64(16)
    at = _runs(k)
    v = vals[np.searchsorted(keys, k[at].astype(np.int64))]
    each = np.repeat(v, np.diff(np.append(at, len(k))))
    return np.bincount((p & np.uint64(0xFFFF)).astype(np.int64), each, n)


def _slabs(seqs: list[bytes], most: int = SLAB):
    """Runs of at most ``most`` bytes, or one longer sequence, and of at most 65,536 sequences."""
    i = 0
    while i < len(seqs):
        j, size = i, 0
        while j < len(seqs) and (j == i or size + len(seqs[j]) <= most) and j - i < 1 << 16:
            size += len(seqs[j])
            j += 1
        yield i, j
        i = j


def _batch(chunk, kind, key, n, blob=None) -> pa.RecordBatch:
    m = len(key)
    cols = [pa.array(np.full(m, chunk, np.int64)), pa.array(np.full(m, kind, np.int32)), pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array([blob] if blob is not None else [None] * m, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["chunk", "kind", "key", "n", "blob"])


_TEXTS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("seq", pa.large_binary())])


def _pack(ids: list, held: list[bool], seqs: list[bytes]) -> bytes:
    """A chunk's texts as compressed batches, so that neither side holds them whole a second time."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _TEXTS, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3), use_threads=False)) as s:
        for i, j in _slabs(seqs, PACKED):
            s.write_batch(pa.RecordBatch.from_arrays([pa.array(c[i:j], f.type) for c, f in zip((ids, held, seqs), _TEXTS)], schema=_TEXTS))
    return sink.getvalue().to_pybytes()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: a chunk's texts.  1: its distinct grams.  2: its distinct words.  n: occurrences in training texts."""
    chunk = TaskContext.get().partitionId() << 32

    def flush():
        yield _batch(chunk, 0, [0], [0], _pack(ids, held, seqs))
        grams, words = _Counter(), _Counter()
        for i, j in _slabs(seqs):
            w = np.array(train[i:j], np.int64)
            g, o = _grams(seqs[i:j])
            grams.add(*_distinct_grams(g, np.repeat(w, np.diff(o))))
            h, o = _word_keys(seqs[i:j])
            words.add(*_fold([(h, np.repeat(w, np.diff(o)))]))
        for kind, c in ((1, grams), (2, words)):
            k, n = c.total()
            for s in range(0, len(k), 50_000):
                yield _batch(chunk, kind, k[s : s + 50_000], n[s : s + 50_000])

    ids, held, train, seqs, size = [], [], [], [], 0
    for b in batches:
        for i, t, h in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            s = normalise(t.as_py())
            if ids and size + len(s) > CHUNK:
                yield from flush()
                chunk += 1
                ids, held, train, seqs, size = [], [], [], [], 0
            ids.append(i)
            held.append(bool(h))
            train.append(0 if h else 1)
            seqs.append(s)
            size += len(s)
    if ids:
        yield from flush()


def _low(col: Column, order: int) -> Column:
    """The symbol with its context of this order."""
    return col.bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1))


def _context(col: Column, order: int) -> Column:
    return F.shiftright(col, 8).bitwiseAND(F.lit((1 << 8 * order) - 1))


def code_lengths(grams: DataFrame) -> DataFrame:
    """(key, lp): log10 probability of each (context, symbol) in ``grams(key, n)``, n its count in training.

    Only Spark joins on packed bytes; tables of orders 0 and 1 have at most
    65,536 rows, and those alone are broadcast.
    """
    entries, nodes = {}, {}
    e = grams.where("n > 0").select("key", "n")
    for j in range(ORDER, -1, -1):
        if j < ORDER:
            e = entries[j + 1].groupBy(_low(F.col("key"), j).alias("key")).agg(F.sum("n").alias("n"))
        entries[j] = e = stage(e, f"ppm-entries{j}")
    few = lambda df, j: F.broadcast(df) if j <= 1 else df  # noqa: E731  256 ** (j + 1) rows at most
    for j in range(ORDER + 1):
        node = entries[j].groupBy(_context(F.col("key"), j).alias("c")).agg(F.sum("n").alias("tot"), F.count("n").alias("q"))
        if j:  # counts, one order down, of the symbols that this context excludes there
            below = few(entries[j - 1].select(F.col("key").alias("k1"), F.col("n").alias("n1")), j - 1)
            out = entries[j].join(below, _low(F.col("key"), j - 1) == F.col("k1")).groupBy(_context(F.col("key"), j).alias("c")).agg(F.sum("n1").alias("x"))
            node = node.join(out, "c")
        else:
            node = node.withColumn("x", F.lit(0).cast("long"))
        nodes[j] = stage(node, f"ppm-nodes{j}")
    d = grams.select("key")
    for j in range(ORDER, -1, -1):
        ej = few(entries[j].select(F.col("key").alias(f"k{j}"), F.col("n").alias(f"n{j}")), j)
        nj = few(nodes[j].select(F.col("c").alias(f"c{j}"), F.col("tot").alias(f"t{j}"), F.col("q").alias(f"q{j}"), F.col("x").alias(f"x{j}")), j - 1)
        d = d.join(ej, _low(F.col("key"), j) == F.col(f"k{j}"), "left").join(nj, _context(F.col("key"), j) == F.col(f"c{j}"), "left").drop(f"k{j}", f"c{j}")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    lp = F.lit(0.0)
    done = F.lit(False)
    for j in range(ORDER, -1, -1):
        up = (zero(f"x{j + 1}"), zero(f"q{j + 1}")) if j < ORDER else (F.lit(0.0), F.lit(0.0))
        t, q = zero(f"t{j}") - up[0], zero(f"q{j}") - up[1]
        seen = zero(f"n{j}") > 0
        step = F.when(seen, F.log10((zero(f"n{j}") - 0.5) / t)).when(q > 0, F.log10(0.5 * q / t)).otherwise(0.0)
        lp = lp + F.when(done, 0.0).otherwise(step)
        done = done | seen
    lp = lp + F.when(done, 0.0).otherwise(-F.log10(F.greatest(F.lit(256.0) - zero("q0"), F.lit(1.0))))
    return d.select("key", lp.alias("lp"))


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(total: int, distinct: int):
    names = [c.split()[0] for c in _OUT.split(", ")]

    def score(texts: pa.Table, values: pa.Table) -> pa.Table:
        side = []
        for k in (1, 2):  # batch by batch, so that the table isn't copied whole
            keys, vals = [], []
            for b in values.to_batches():
                own = b.column("kind").to_numpy() == k
                keys.append(b.column("key").to_numpy()[own])
                vals.append(b.column("val").to_numpy()[own])
            keys, vals = (np.concatenate(z) if z else np.zeros(0) for z in (keys, vals))
            by = np.argsort(keys)
            side.append((keys[by], vals[by]))
        del values, keys, vals, by
        (gk, gv), (wk, wv) = side
        base = np.log10((wv + 1) / (total + distinct + 1))
        cols: list[list] = [[] for _ in names]
        for blob in texts["blob"]:
            for t in pa.ipc.open_stream(blob.as_buffer(), options=pa.ipc.IpcReadOptions(use_threads=False)):
                seqs = t["seq"].to_pylist()
                cols[0] += t["doc_id"].to_pylist()
                cols[1] += t["held_out"].to_pylist()
                for i, j in _slabs(seqs):
                    h, o = _word_keys(seqs[i:j])
                    u, at = np.unique(h, return_inverse=True)
                    w = np.searchsorted(wk, u)[at]
                    cols[2] += np.diff(o).tolist()
                    cols[3] += np.add.reduceat((wv[w] > 0).astype(np.int64), o[:-1]).tolist()
                    cols[5] += np.add.reduceat(base[w], o[:-1]).tolist()
                    g, o = _grams(seqs[i:j])
                    cols[6] += _gram_sums(g, o, gk, gv).tolist()
        cols[4] = [total] * len(cols[0])
        kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return score


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each whole text.

    ``held_out``, over doc_id, says which texts the model doesn't learn from.
    ``score`` is the log10 probability of the normalised bytes; ``base_score``
    that of an add-one unigram model of words.  A null or blank text is one
    end.  With nothing to learn from, every byte is uniform over 256.  Repeated
    rows are learned and scored each; a null doc_id is scored like any other.
    """
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"))
    rows = stage(d.mapInArrow(_chunks, _SCHEMA), "ppm-chunks")
    # a key comes once from each chunk that has it; it goes back to those chunks
    counts = rows.where("kind > 0").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.collect_list("chunk").alias("chunks"))
    counts = stage(counts, "ppm-counts")
    words, grams = counts.where("kind = 2"), counts.where("kind = 1")
    total, distinct = words.agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1))).first()
    # single precision halves what goes back; a probability keeps seven digits
    lp = code_lengths(grams.select("key", "n")).select(F.col("key").alias("k"), F.col("lp").cast("float").cast("double").alias("val"))
    of_grams = grams.join(lp, grams.key == lp.k).select("kind", "key", "val", "chunks")
    of_words = words.select("kind", "key", F.col("n").cast("double").alias("val"), "chunks")
    asked = of_grams.union(of_words).select(F.explode("chunks").alias("chunk"), "kind", "key", "val")
    texts = rows.where("kind = 0").select(F.col("chunk").alias("c"), "blob")
    return texts.groupBy("c").cogroup(asked.groupBy("chunk")).applyInArrow(_scorer(int(total or 0), int(distinct or 0)), _OUT)
