"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by their number of shingles.  An item keeps the k
smallest values of one hash over its shingles, k growing with the partition.
If a share t of an item's n shingles lies in a document, at most
n - ceil(t * n) are absent, so of its k retained values at least
k - (n - ceil(t * n)) are found: probing for retained values loses no item.
Documents probe only partitions that they are large enough for, and what is
found is verified with exact shingle containment, on 128 bits a shingle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import add_columns, pick, text_bytes, unclash
from .words import shingles, word_hashes

WIDTH = 5
THRESHOLD = 0.8
#: Item text shipped to the executors at once; more items go in further passes.
MAX_BROADCAST_BYTES = 32 << 20
_FILTER_BITS = 20


def _lanes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of a text's words."""
    o = np.array([0, len(x)], np.int64)
    return word_hashes(x, o)[0], word_hashes(x, o, 1)[0]


class _Partition:
    """Items whose shingle counts lie in one power of two, all of one shingle width."""

    def __init__(self, width: int, items: list[tuple[int, np.ndarray, frozenset]], t: float):
        self.width = width
        self.ids = [i for i, _, _ in items]
        self.sets = [s for _, s, _ in items]
        self.pairs = [p for _, _, p in items]
        self.least = min(math.ceil(t * len(s) - 1e-9) for s in self.sets)  # a document with fewer shingles can't contain any
        kept, owner, need = [], [], []
        largest = max(len(s) for s in self.sets)
        k = 2 * (largest - math.ceil(t * largest - 1e-9)) + 1  # bottom-k of this partition
        for j, s in enumerate(self.sets):
            own = s[: max(1, min(k, len(s)))]  # sets are sorted: the k smallest
            kept.append(own)
            owner.append(np.full(len(own), j))
            need.append(max(1, len(own) - (len(s) - math.ceil(t * len(s) - 1e-9))))
        values, owners = np.concatenate(kept), np.concatenate(owner)
        by = np.argsort(values, kind="stable")
        self.values, self.owners, self.need = values[by], owners[by], np.array(need)


class Index:
    """Size-partitioned index over test items."""

    def __init__(self, items: list[tuple[int, str]], width: int = WIDTH, t: float = THRESHOLD):
        self.t, self.widths = t, {}
        sized: dict[tuple[int, int], list] = {}
        for i, text in items:
            h, g = _lanes(np.frombuffer((text or "").encode("utf-8"), np.uint8))
            if not len(h):
                continue
            w = min(width, len(h))
            every = shingles(h, w)
            s = np.unique(every)
            sized.setdefault((w, len(s).bit_length()), []).append((i, s, frozenset(zip(every.tolist(), shingles(g, w).tolist()))))
        for (w, _), own in sorted(sized.items()):
            self.widths.setdefault(w, []).append(_Partition(w, own, t))
        self.filters = {}
        for w, parts in self.widths.items():
            table = np.zeros(1 << _FILTER_BITS, bool)
            for p in parts:
                table[(p.values >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.filters[w] = table

    def search(self, x: np.ndarray, o: np.ndarray) -> dict[int, list[tuple[int, float]]]:
        """{text: [(item, containment)]} over the bytes and offsets of several texts."""
        h, wo = word_hashes(x, o)
        found: dict[int, list] = {}
        for w, parts in self.widths.items():
            every = shingles(h, w)
            hit = np.flatnonzero(self.filters[w][(every >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            doc = np.searchsorted(wo, hit, "right") - 1
            inside = hit + w <= wo[doc + 1]  # not across texts
            hit, doc = hit[inside], doc[inside]
            size = np.maximum(np.diff(wo) - w + 1, 0)
            for p in parts:
                v = every[hit]
                a, b = np.searchsorted(p.values, v), np.searchsorted(p.values, v, "right")
                at = np.flatnonzero((b > a) & (size[doc] >= p.least))
                if not len(at):
                    continue
                for d in np.unique(doc[at]).tolist():
                    own = at[doc[at] == d]
                    _, one = np.unique(v[own], return_index=True)
                    owners = np.concatenate([p.owners[a[i] : b[i]] for i in own[one].tolist()])
                    which, hits = np.unique(owners, return_counts=True)
                    which = which[hits >= p.need[which]]
                    if not len(which):
                        continue
                    text = every[wo[d] : wo[d + 1] - w + 1]
                    second = shingles(_lanes(x[o[d] : o[d + 1]])[1], w)
                    for j in which.tolist():
                        own = np.flatnonzero(np.isin(text, p.sets[j]))
                        share = len(p.pairs[j].intersection(zip(text[own].tolist(), second[own].tolist()))) / len(p.pairs[j])
                        if share >= self.t - 1e-12:
                            found.setdefault(d, []).append((p.ids[j], share))
        return found


def _slices(items: DataFrame, most: int) -> tuple[DataFrame, int]:
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return items.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, math.ceil(1.5 * total / most))))), max(1, math.ceil(1.5 * total / most))


def find_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``docs`` with ``item_ids`` (array<long>, ascending) and ``containment`` (largest share, 0 if none).

    An item is in a document if at least ``threshold`` of its distinct word
    shingles are.  An item of fewer than ``width`` words is one shingle of all
    its words; one without words is in no document.  A null or empty document
    holds nothing.  Other columns stay, but for those whose names clash.  Repeated rows are judged each; equal item ids are one.

    The index of the items is broadcast behind a check of their size; a larger
    benchmark is taken in slices, each a further narrow pass over the documents.
    """
    sc = docs.sparkSession.sparkContext
    it, n = _slices(pick(items, "item_id", "text").where("text IS NOT NULL AND item_id IS NOT NULL"), max_bytes)
    docs = out = unclash(docs, ["text"], ["item_ids", "containment"])
    for k in range(n):
        index = sc.broadcast(Index([(int(r[0]), r[1]) for r in it.where(F.col("slice") == k).select("item_id", "text").collect()], width, threshold))

        def make(b: pa.RecordBatch, index=index) -> list[pa.Array]:
            x, o = text_bytes(b.column(0))
            found = index.value.search(x, o)
            ids = [sorted({i for i, _ in found.get(d, [])}) for d in range(b.num_rows)]
            best = [max((s for _, s in found.get(d, [])), default=0.0) for d in range(b.num_rows)]
            return [pa.array(ids, pa.list_(pa.int64())), pa.array(best, pa.float64())]

        names = (f"_items{k}", f"_share{k}")
        out = add_columns(out, [T.StructField(names[0], T.ArrayType(T.LongType())), T.StructField(names[1], T.DoubleType())], make, ["text"])
    ids = F.array_sort(F.array_distinct(F.flatten(F.array(*(f"_items{k}" for k in range(n))))))
    share = F.greatest(*(f"_share{k}" for k in range(n))) if n > 1 else F.col("_share0")
    return out.select(*docs.columns, ids.alias("item_ids"), share.alias("containment"))
