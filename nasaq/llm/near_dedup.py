"""Near-duplicate documents by bottom-k MinHash sketches.

One hash function over word shingles.  A document keeps the K smallest values.
Inverted lists over retained values generate candidate pairs, the union sketch
estimates their similarity and drops the far ones, and exact Jaccard over the
full sets confirms links.  Components of the links are the groups.

* Texts with the same set are one class; only class representatives go on.
* A list's key is several retained values at once: the values are dealt into
  bins, and a key holds the smallest values of BAND bins.  Small sets use prefix
  lists instead: similar sets share at least two of their few rarest values.
* Each list first gives star pairs, each member with one hub; the hub is the
  member whose lists hold most others, as a group's original does.  All other
  pairs are formed only between members that aren't connected by then.
* Members of a list of over HOT that isn't connected are compared with one hub
  of it.  Those near the hub meet by the changes to it that they share, those
  far from it by their rarest shingles (``_change_lists``); both are exact.
* Signatures of a few bits, one per bin and parities, go with a list's members
  and keep far pairs from being formed at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .frames import by_bytes, clean, discard, pick, stage, text_bytes
from .words import mix, text_pairs, text_shingles, word_hashes

#: Retained values: the bottom K of the hash over a document's shingles.
K = 256
#: Of those, values that go with a pair for the estimate.
ESTIMATE = 96
#: A pair goes on when its estimate is no more than this below the threshold (over six standard deviations).
MARGIN = 0.25
BINS, BAND = 72, 3
#: Members of a list that meet in it directly.
HOT = 32
#: Bits of a signature; at a similarity of 0.8, 13 differ on average, with a deviation of 3.4.
BITS = 128
AGREE_DEVIATIONS = 6.8
#: Bits of the parity signature.
PARITY = 256
#: Similarity to a hub, in percent, below which a set is far from it; it decides the route, not the result.
NEAR = 70
#: Up to SMALL shingles a set has prefix lists; from OVERLAP on it has bin lists; in between, both.
SMALL, OVERLAP = 80, 64
#: Bytes of a text up to which its shingles, if it has no more than SMALL, count for the order in prefix lists; longer
#: texts of few shingles are listed in the same order.
BRIEF = 2048
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_U = np.uint64


def list_keys(s: np.ndarray, percent: int, often: np.ndarray | None = None) -> np.ndarray:
    """Keys of the inverted lists for a sorted set of shingle hashes.

    Similar sets share two keys at least: small sets surely, others with a
    probability of over 1 - 1e-6.  Sets that can only be similar to an equal
    one have no key.  Small sets are listed under their rarest values by the
    counters ``often``, ties by value: lists of common ones grow with the corpus.
    """
    n, keys = len(s), []
    need = -(-percent * n // 100)
    if need < 2 or 100 * n < percent * (n + 1):
        return np.zeros(0, np.int64)
    if n <= SMALL:
        first = s if often is None else s[np.lexsort((s, often[_counter(0, s)]))]
        keys.append(mix(first[: n - need + 2] ^ _U(0x51)))
    if n >= OVERLAP:
        kept = s[:K]
        g = _bins(kept, BINS, 0).reshape(BINS // BAND, BAND)
        with np.errstate(over="ignore"):
            h = np.arange(1, len(g) + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
            for j in range(BAND):
                h = mix(h ^ g[:, j]) + _U(j)
        keys.append(h[(g != _EMPTY).any(1)])
    return np.unique(np.concatenate(keys)).view(np.int64)


def _bins(kept: np.ndarray, n: int, salt: int) -> np.ndarray:
    """The smallest of the ascending values that fall into each of n bins."""
    bins = np.full(n, _EMPTY, _U)
    bins[(mix(kept ^ _U(salt)) % _U(n)).astype(np.int64)[::-1]] = kept[::-1]  # the smallest is written last
    return bins


def bit_signature(s: np.ndarray) -> tuple[int, int]:
    """One bit of the smallest retained value of each bin; an empty bin has 0."""
    g = _bins(s[:K], BITS, 0x7F)
    bit = np.where(g == _EMPTY, _U(0), mix(g) & _U(1)).astype(np.uint8)
    a, b = np.packbits(bit).view(np.int64)
    return int(a), int(b)


def parity_signature(s: np.ndarray) -> tuple[int, ...]:
    """Parity of the number of shingles that fall to each of PARITY bits: two sets differ in no more bits than shingles."""
    odd = np.bincount((mix(s ^ _U(0x2B)) % _U(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return tuple(np.packbits(odd.astype(np.uint8)).view(np.int64).tolist())


_BITS = [f"b{i}" for i in range(BITS // 64)] + [f"p{i}" for i in range(PARITY // 64)]
_SKETCH = "doc_id long, n_shingles long, sig binary, keys array<long>, sketch binary, " + ", ".join(f"{x} long" for x in _BITS)


def _sketches(width: int, percent: int, often):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1):
            x, o = text_bytes(b.column(1))
            n, sig, keys, sketch, bits = [], [], [], [], []
            for s, t in text_pairs(x, o, width):
                n.append(len(s))
                sig.append(xxhash.xxh3_128_digest(s.tobytes() + t.tobytes()) if len(s) else None)
                s = np.unique(s)
                keys.append(list_keys(s, percent, often.value))
                sketch.append(s[:ESTIMATE].tobytes())
                bits.append((*bit_signature(s), *parity_signature(s)))
            off = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat)), pa.array(sketch, pa.binary()), *(pa.array([x[i] for x in bits], pa.int64()) for i in range(len(_BITS)))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "sig", "keys", "sketch", *_BITS])

    return run


def _sets_of(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Each text's set, of 64-bit values."""
    return map(np.unique, text_shingles(*word_hashes(*text_bytes(texts)), width))


def _sets(width: int):
    """(id, s): each text's set, of 64-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1):
            sets = [s.tobytes() for s in _sets_of(b.column(1), width)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["id", "s"])

    return run


def _buffers(b: pa.RecordBatch, *columns: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The 64-bit values of each row's binary columns, as views of the batch."""
    views = []
    for c in columns:
        x, o = text_bytes(b.column(c))
        views.append((x, o.tolist()))
    for i in range(b.num_rows):
        yield tuple(x[o[i] : o[i + 1]].view(_U) for x, o in views)


def _near(k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (sa, sb) in enumerate(_buffers(b, 2, 3)):
                u = np.sort(np.concatenate([sa, sb]))
                same = u[1:] == u[:-1]
                union = np.append(u[:-1][~same], u[-1])[:k]
                both = int((u[:-1][same] <= union[-1]).sum())
                keep[i] = both >= least * len(union)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def _exact(width: int, percent: int):
    """(a, b) of rows (a, b, x, y) whose texts x and y have similar sets, of 128-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(by_bytes(batches, 2), 3):
            keep = np.zeros(b.num_rows, bool)
            sets = (text_pairs(*text_bytes(b.column(c)), width) for c in (2, 3))
            for i, ((ua, va), (ub, vb)) in enumerate(zip(*sets)):
                u, v = np.concatenate([ua, ub]), np.concatenate([va, vb])
                by = np.argsort(u, kind="stable")
                u, v = u[by], v[by]
                both = int(((u[1:] == u[:-1]) & (v[1:] == v[:-1])).sum())
                keep[i] = both and 100 * both >= percent * (len(u) - both)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


#: So many ids are broadcast to pick texts; more are joined by a shuffle.
_FEW_IDS = 1_000_000


def _sketches_of(pairs: DataFrame, reps: DataFrame, every: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(id, sketch) of the representatives in the pairs, and the staged table that it reads; no other sketch is shuffled while ids are few."""
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    ids = stage(reps.select("doc_id", F.col("sig").alias("of")).join(ends, F.col("doc_id") == F.col("id")).select("id", "of"), f"{name}-ends")
    few = ids.count() <= _FEW_IDS
    own = every.join(F.broadcast(ids) if few else ids, (F.col("doc_id") == F.col("id")) & (F.col("sig") == F.col("of")), "left_semi")
    own = own.select(F.col("doc_id").alias("id"), "sig", "sketch").repartition("id").dropDuplicates(["id", "sig"])
    return own.select("id", "sketch"), ids


def _confirm(pairs: DataFrame, reps: DataFrame, every: DataFrame, texts: DataFrame, width: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) whose full sets, of 128-bit values, are similar; ``every`` has the sketches."""
    sk, ends = _sketches_of(pairs, reps, every, name)
    half = pairs.join(sk, pairs.a == sk.id).select("a", "b", F.col("sketch").alias("x"))
    est = half.join(sk, half.b == sk.id).select("a", "b", "x", F.col("sketch").alias("y"))
    near = stage(est.mapInArrow(_near(ESTIMATE, percent / 100 - MARGIN), "a long, b long"), f"{name}-near")
    ids = near.select(F.col("a").alias("id")).union(near.select("b")).distinct()
    ids = stage(ids, f"{name}-ids")
    discard(ends)
    clean(pairs.sparkSession)
    few = ids.count() <= _FEW_IDS
    # texts go to the pairs, and their sets are made there: a set's values are several times its text, and don't compress
    own = texts.join(F.broadcast(ids) if few else ids, texts.doc_id == ids.id, "left_semi").select(F.col("doc_id").alias("id"), "text")
    half = near.join(own, near.a == own.id).select("a", "b", F.col("text").alias("x"))
    full = half.join(own, half.b == own.id).select("a", "b", "x", F.col("text").alias("y"))
    links = stage(full.mapInArrow(_exact(width, percent), "a long, b long"), f"{name}-links")
    discard(near, ids)
    return links


def _sized(percent: int) -> "F.Column":
    """Whether sizes of a and b leave room for a link."""
    return 100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")


def _alike(percent: int) -> "F.Column":
    """Whether sizes and signatures of a and b leave room for a link.

    Of linked sets no more than (1 - t) / (1 + t) of both sizes differ, and no
    fewer than the parities that do; this is exact, and tells most of small sets.
    """
    apart = {k: sum((F.bit_count(F.col(f"a.{x}").bitwiseXOR(F.col(f"b.{x}"))) for x in _BITS if x[0] == k), F.lit(0)) for k in "bp"}
    parity = (100 + percent) * apart["p"] <= (100 - percent) * (F.col("a.n") + F.col("b.n"))
    return _sized(percent) & parity & (apart["b"] <= _most_apart(percent))


def _most_apart(percent: int) -> int:
    """Bits that may differ: the mean of similar sets and nearly seven deviations."""
    p = (1 - percent / 100) / 2
    return int(BITS * p + (AGREE_DEVIATIONS * (BITS * p * (1 - p)) ** 0.5) + 0.5)


def _changes(percent: int):
    """(h, id, nh, r, g, near, far, ch): what a set lacks of its hub's (r values) and has besides (g values); ch only of the near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nh, r, g, near, ch = [], [], [], [], []
            for a, h in _buffers(b, 2, 3):
                lacks, besides = np.setdiff1d(h, a, assume_unique=True), np.setdiff1d(a, h, assume_unique=True)
                nh.append(len(h))
                r.append(len(lacks))
                g.append(len(besides))
                near.append(100 * (len(h) - len(lacks)) >= (NEAR - 100 + percent) * (len(h) + len(besides)))
                ch.append(np.concatenate([lacks, besides]) if near[-1] else np.zeros(0, _U))
            far = [100 * (n - x) < NEAR * (n + y) for n, x, y in zip(nh, r, g)]
            cols = [b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in (nh, r, g)), *(pa.array(x, pa.bool_()) for x in (near, far)), pa.array([c.tobytes() for c in ch], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["h", "id", "nh", "r", "g", "near", "far", "ch"])

    return run


#: Counters of a count sketch: its size is fixed, however many values are counted.
COUNTERS = 1 << 18


def _counter(h, v: np.ndarray) -> np.ndarray:
    """The counter of each value v of hub h."""
    with np.errstate(over="ignore"):
        return (mix(v ^ mix(np.array([h], np.int64).view(_U) + _U(0x3C6EF372FE94F82B))) % _U(COUNTERS)).astype(np.int64)


def _counted(values: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]):
    """(i, n): how many of a task's ``values`` (h, s) each counter has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for h, s in values(b):
                n += np.bincount(_counter(h, s), minlength=COUNTERS) if len(s) > COUNTERS // 16 else 0
                if len(s) <= COUNTERS // 16:
                    np.add.at(n, _counter(h, s), 1)
        i = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(n[i])], names=["i", "n"])

    return run


def _stored(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Values of rows (h, s binary)."""
    return ((h, s) for h, (s,) in zip(b.column(0).to_pylist(), _buffers(b, 1)))


def _small_sets(width: int):
    """Values of rows (doc_id, text): the sets of up to SMALL, of no hub."""
    return lambda b: ((0, s) for c in by_bytes(iter([b]), 1) for s in _sets_of(c.column(1), width) if len(s) <= SMALL)


def _frequencies(rows: DataFrame, values: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]] = _stored):
    """A broadcast count sketch of the values (h, s): COUNTERS numbers at most, by one aggregation of each task's counters.

    ``values`` are made where they are counted.  Two Python maps in one task
    take a worker each, and Spark keeps all workers for the tasks that follow.
    """
    found = rows.mapInArrow(_counted(values), "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(COUNTERS, np.int64)
    n[found["i"].to_numpy()] = found["n"].to_numpy()
    return rows.sparkSession.sparkContext.broadcast(np.minimum(n, 0xFFFFFFFF).astype(np.uint32))


def _prefixes(often):
    """(h, id, ks): of rows (h, id, n, s) the n rarest values by the sketch, ties by value, as list keys.

    A prefix filter needs one total order that all sets share, not exact
    frequencies; the sketch only keeps lists short.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, n, (s,) in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), _buffers(b, 3)):
                by = np.lexsort((s, often.value[_counter(h, s)]))[: max(n, 0)]
                out.append(mix(s[by] ^ mix(np.array([h], np.int64).view(_U))).view(np.int64))
            off = np.concatenate([[0], np.cumsum([len(k) for k in out])]).astype(np.int32)
            ks = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), ks], names=["h", "id", "ks"])

    return run


_PREFIX = "h long, id long, ks array<long>"


def _change_lists(long: DataFrame, weight: DataFrame, texts: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """(changed, rare, links, hubs, the staged tables they read) for long lists (key, a, c), each compared with one hub.

    ``changed`` lists sets that are near a hub H.  Let r values of H be lacking
    in a set and g be there besides, c = r + t * g, and B = (1 - t) * |H|.  The
    set is linked with H when c <= B.  Sets x and y are linked when they have k
    changes in common with (1 + t) * k >= c_x + c_y - B.  If both are linked
    with H they are connected already; else say c_x > B: they share over
    c_y / (1 + t) changes of y, and c_x - B of x.  So y is listed under so many
    of its rarest changes, x under so many of its own, that such sets share a
    list (the prefix filter).  Copies of one original that share no change make
    no pair.

    ``rare`` lists sets that are far from a hub under the n - need + 1 rarest
    of their n shingles, one of which is in any similar set.  Similar sets are
    both far, or both near with 1 - t to spare, as 1 - Jaccard is a metric.
    """
    weighed = long.join(weight, F.col("a.id") == F.col("w_id"))
    hub = weighed.groupBy("key").agg(F.min(F.struct((-F.col("w")).alias("o"), F.col("a.id").alias("id"))).alias("h")).select("key", F.col("h.id").alias("h"))
    own = stage(long.join(hub, "key").where(F.col("a.id") != F.col("h")).select("a", "c", "h").distinct(), "near-hubs")
    ids = stage(own.select(F.col("a.id").alias("id")).union(own.select("h")).distinct(), "near-hub-ids")
    some = texts.join(F.broadcast(ids) if ids.count() <= _FEW_IDS else ids, texts.doc_id == ids.id, "left_semi")
    sets = stage(some.mapInArrow(_sets(width), "id long, s binary"), "near-hub-sets")
    of_hub = sets.select(F.col("id").alias("h"), F.col("s").alias("sh"))
    both = own.select(F.col("a.id").alias("id"), "h").join(sets, "id").join(of_hub, "h").select("h", "id", F.col("s").alias("sa"), "sh")
    ch = stage(both.mapInArrow(_changes(percent), "h long, id long, nh long, r long, g long, near boolean, far boolean, ch binary").repartition("h", "id"), "near-changes")
    cost, room = 100 * F.col("r") + percent * F.col("g"), (100 - percent) * F.col("nh")
    links = ch.where(cost <= room).select(F.least("id", "h").alias("a"), F.greatest("id", "h").alias("b"))

    near, size = ch.where("near"), F.octet_length("ch") / 8
    as_y = size - F.floor(cost / (100 + percent))
    as_x = F.when(cost > room, size - F.greatest(F.lit(1), F.ceil((cost - room) / 100)) + 1).otherwise(0)
    near = near.select("h", "id", as_x.cast("int").alias("nx"), as_y.cast("int").alias("ny"), "ch")
    often = _frequencies(near.select("h", "ch"))
    slots = near.select("h", "id", F.greatest("nx", "ny").alias("n"), "ch").where("n > 0").mapInArrow(_prefixes(often), _PREFIX)
    of = own.select(F.col("h").alias("h2"), F.col("a.id").alias("id2"), "a", "c")
    roles = near.select(F.col("h").alias("h3"), F.col("id").alias("id3"), "nx", "ny")
    one = slots.join(of, (F.col("h") == F.col("h2")) & (F.col("id") == F.col("id2"))).join(roles, (F.col("h") == F.col("h3")) & (F.col("id") == F.col("id3")))
    one = stage(one.select("ks", "a", "c", "nx", "ny"), "near-prefixes")  # one row a set: lists are dealt out after the joins
    changed = one.select("a", "c", "nx", "ny", F.posexplode("ks").alias("i", "key")).select("key", "a", "c", (F.col("i") < F.col("nx")).alias("x"), (F.col("i") < F.col("ny")).alias("y"))

    far = ch.where("far").select(F.col("id").alias("far_id")).distinct()
    far = own.select("a", "c").distinct().join(far, F.col("a.id") == F.col("far_id")).select("a", "c", "far_id")
    least = F.floor((percent * F.col("a.n") + 99) / 100)
    values = sets.join(far, F.col("id") == F.col("far_id")).select(F.lit(0).cast("long").alias("h"), "id", (F.col("a.n") - least + 1).cast("int").alias("n"), "s")
    values = stage(values, "near-far-sets")
    often = _frequencies(values.select("h", "s"))
    slots = values.mapInArrow(_prefixes(often), _PREFIX)
    rest = stage(slots.join(far, F.col("id") == F.col("far_id")).select("ks", "a", "c"), "near-far-prefixes")
    yes = F.lit(True)
    rare = rest.select(F.explode("ks").alias("key"), "a", "c", yes.alias("x"), yes.alias("y"))
    used = [own, ids, sets, ch, one, values, rest]
    return changed, rare, links, ch.select(F.col("id").alias("h_id"), "h", "near"), used


def _mixed(lists: DataFrame, name: str) -> DataFrame:
    """Lists of more than one component in which a pair can be formed, with their length m."""
    many = lists.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m"), F.max("x").alias("some_x"), F.max("y").alias("some_y")).where("lo <> hi AND some_x AND some_y").select("key", "m")
    return stage(lists.join(many, "key"), name)


def _pairs(lists: DataFrame, hubs: DataFrame | None, marks: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a list; sets with a common hub in ``hubs`` meet by their changes instead.

    ``marks`` has the members' signatures, which lists don't carry until pairs are formed.
    """
    marks = marks.select(F.col("a").alias("mark"))
    lists = lists.join(marks, (F.col("a.id") == F.col("mark.id")) & (F.col("a.n") == F.col("mark.n"))).drop("a").withColumnRenamed("mark", "a")
    none = F.array().cast("array<long>")
    if hubs is None:
        lists = lists.withColumn("hs", none)
    else:
        of = hubs.groupBy("h_id").agg(F.collect_set("h").alias("hs"))
        lists = lists.join(of, F.col("a.id") == F.col("h_id"), "left").withColumn("hs", F.coalesce("hs", none)).drop("h_id")
    left = lists.select("key", "a", F.col("c").alias("ca"), F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("hs").alias("ha"))
    right = lists.select("key", F.col("a").alias("b"), F.col("c").alias("cb"), F.col("x").alias("xb"), F.col("y").alias("yb"), F.col("hs").alias("hb"))
    role = (F.col("xa") & F.col("yb")) | (F.col("ya") & F.col("xb"))
    meet = left.join(right, (left["key"] == right["key"]) & (F.col("a.id") < F.col("b.id")) & (F.col("ca") != F.col("cb")) & role & _alike(percent) & ~F.arrays_overlap("ha", "hb"))
    return meet.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    Documents are linked when 100 * |A and B| >= percent * |A or B| over their
    sets of distinct ``width``-word shingles; component_id is the smallest
    doc_id reachable.  A text with fewer words is one shingle of all its words;
    one without words, or a null text, has an empty set and no link.  Rows with
    a null doc_id are left out; rows that share a doc_id appear each, with the
    group of their own text.
    """
    texts = pick(docs, "doc_id", "text").where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long"))
    often = _frequencies(texts.where(F.octet_length("text") <= BRIEF), _small_sets(width))
    every = stage(texts.mapInArrow(_sketches(width, percent, often), _SKETCH), "near-sketches")
    classes = stage(every.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("rep")), "near-classes")
    joined = every.where("sig IS NOT NULL").join(classes.withColumnRenamed("sig", "csig"), (F.col("sig") == F.col("csig")) & (F.col("doc_id") == F.col("rep")))
    # sketches are most of a row and stay where they are: few of them go with a pair
    reps = stage(joined.select("doc_id", "sig", "n_shingles", "keys", *_BITS).dropDuplicates(["doc_id", "sig"]), "near-reps")
    clean(docs.sparkSession)

    # a list's member is its id and size: most lists end here, and signatures are many times that
    lists = reps.select(F.explode("keys").alias("key"), F.struct(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n")).alias("a"))
    sizes = lists.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    lists = stage(lists.join(sizes, "key"), "near-lists")
    clean(docs.sparkSession)
    weight = stage(lists.groupBy(F.col("a.id").alias("w_id")).agg(F.sum("m").alias("w")), "near-weights")
    # the member whose lists hold most, ties to the smaller id: one hub for all of a group's lists
    weighed = lists.join(weight, F.col("a.id") == F.col("w_id"))
    hubs = weighed.groupBy("key").agg(F.min(F.struct((-F.col("w")).alias("o"), "a")).alias("h")).select("key", F.col("h.a").alias("b"))
    star = lists.join(hubs, "key").where((F.col("a.id") != F.col("b.id")) & _sized(percent)).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    one = reps.select(F.struct(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), *_BITS).alias("a"))
    for end, of in (("x", "a"), ("y", "b")):
        star = star.join(one.select(F.col("a").alias(of)), (F.col(f"{end}.id") == F.col(f"{of}.id")) & (F.col(f"{end}.n") == F.col(f"{of}.n")))
    star = stage(star.where(_alike(percent)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct(), "near-star")
    clean(docs.sparkSession)
    links = _confirm(star, reps, every, texts, width, percent, "near-star")
    first = connected_components(links)
    clean(docs.sparkSession)

    comp = lists.join(first.select(F.col("id").alias("cid"), "component"), F.col("a.id") == F.col("cid"), "left").select("key", "a", "m", F.coalesce("component", "a.id").alias("c"))
    mixed = comp.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    rest = stage(comp.join(mixed, "key"), "near-rest")
    ids = rest.select(F.col("a.id").alias("id")).distinct()
    marks = stage(one.join(ids, F.col("a.id") == F.col("id"), "left_semi"), "near-marks")
    clean(docs.sparkSession)
    changed, rare, hub_links, hubs, used = _change_lists(rest.where(F.col("m") > HOT).select("key", "a", "c"), weight, texts, width, percent)
    hub_links = stage(hub_links.distinct(), "near-hub-links")
    yes = F.lit(True)
    short = rest.where(F.col("m") <= HOT).select("key", "a", "c", yes.alias("x"), yes.alias("y"))
    changed, rare = _mixed(changed, "near-changed"), _mixed(rare, "near-rare")
    # staged one by one: the plans stay small
    kinds = ((short, hubs, "short"), (changed, None, "changed"), (rare, hubs.where("near"), "rare"))
    pairs = [stage(_pairs(lists_, hubs_, marks, percent), f"near-{kind}-pairs") for lists_, hubs_, kind in kinds]
    cross = pairs[0].union(pairs[1]).union(pairs[2])
    cross = cross.union(hub_links).distinct().join(star, ["a", "b"], "left_anti")
    more = _confirm(cross, reps, every, texts, width, percent, "near-cross")
    discard(*used, *pairs, changed, rare, rest, marks, lists, weight, star, reps)
    clean(docs.sparkSession)

    comps = connected_components(first.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
    of = classes.join(comps, F.col("rep") == F.col("id"), "left").select(F.col("sig").alias("csig"), F.coalesce("component", "rep").alias("component_id"))
    out = every.select("doc_id", "n_shingles", "sig").join(of, F.col("sig") == F.col("csig"), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
