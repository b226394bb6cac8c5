"""Language identification as inference of a multilingual mixture.

Each language has a smoothed distribution of hashed byte trigrams.  A document
is a mixture of languages; expectation-maximisation estimates its proportions,
and the set of languages is the one with the best penalised likelihood.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import add_columns, pick, text_bytes, unclash
from .words import LOWER

BITS = 15
FEATURES = 1 << BITS
#: The model is collected and broadcast: this many languages of FEATURES counts at most.
MAX_LANGUAGES = 2000
ROUNDS = 8
#: Neighbouring trigrams share bytes, so log-likelihoods count a third.
OVERLAP = 3.0
SLAB = 1 << 18
_PROBABILITY_FLOOR = 0.5


def _features(x: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of each text, with the number of its text."""
    y = LOWER[x[o[0] : o[-1]]].astype(np.uint32)
    n = len(y) - 2
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    f = ((y[:n] << np.uint32(16) | y[1 : n + 1] << np.uint32(8) | y[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    doc = np.repeat(np.arange(len(o) - 1), np.diff(o))
    inside = doc[:n] == doc[2:]
    return f[inside].astype(np.int64), doc[:n][inside]


def _slabs(o: np.ndarray, size: int = SLAB):
    i = 0
    while i < len(o) - 1:
        j = max(i + 1, int(np.searchsorted(o, o[i] + size, "right")) - 1)
        yield i, min(j, len(o) - 1)
        i = min(j, len(o) - 1)


def _counts(batches):
    tables: dict[str, np.ndarray] = {}
    for b in batches:
        x, o = text_bytes(b.column(0))
        langs = b.column(1).to_pylist()
        names = {l: i for i, l in enumerate(dict.fromkeys(langs))}
        code = np.array([names[l] for l in langs], np.int64)
        for i, j in _slabs(o):
            f, doc = _features(x, o[i : j + 1])
            c = np.bincount(code[i:j][doc] * FEATURES + f, minlength=len(names) * FEATURES).reshape(len(names), FEATURES)
            for l, k in names.items():
                if l in tables:
                    tables[l] += c[k]
                elif c[k].any() or (code[i:j] == k).any():
                    tables[l] = c[k].copy()
    for l, c in tables.items():
        at = np.flatnonzero(c)
        at = at if len(at) else np.zeros(1, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([l] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "f", "n"])


class Model:
    """``langs``, sorted; ``p[f, l]``, the probability of feature f in language l; ``prior``, the commonest first."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts.T.astype(np.float64) + _PROBABILITY_FLOOR
        self.p = smooth / smooth.sum(0, keepdims=True) if langs else smooth
        self.first = int(np.argmax(counts.sum(1))) if langs else 0


def train(labelled: DataFrame) -> Model:
    """A model from all rows with text and a non-null ``lang``; sums of trigram counts are made by Spark."""
    rows = pick(labelled, "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    sums = rows.mapInArrow(_counts, "lang string, f int, n long").groupBy("lang", "f").agg(F.sum("n").alias("n"))
    t = sums.limit(MAX_LANGUAGES * FEATURES + 1).toArrow()
    if len(t) > MAX_LANGUAGES * FEATURES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = t["lang"].combine_chunks().dictionary_encode()
    own = names.dictionary.to_pylist()
    langs = sorted(own)
    counts = np.zeros((len(langs), FEATURES), np.int64)
    if langs:
        at = np.array([langs.index(l) for l in own])
        counts[at[names.indices.to_numpy()], t["f"].to_numpy()] = t["n"].to_numpy()
    return Model(langs, counts)


def _sum_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first, axis=0)


def _em(pf, c, doc, first, n, pi, rounds):
    """EM rounds over all documents of a slab; returns proportions and log-likelihoods."""
    for _ in range(rounds):
        r = pf * pi[doc]
        r *= (c / r.sum(1))[:, None]
        pi = _sum_by(r, first) / n[:, None]
    ll = _sum_by(c * np.log(np.maximum((pf * pi[doc]).sum(1), 1e-300)), first)
    return pi, ll


def proportions(x: np.ndarray, o: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """For each text its mixture over the selected languages, and whether it had a trigram."""
    d, L = len(o) - 1, len(model.langs)
    out, some = np.zeros((d, L)), np.zeros(d, bool)
    f, doc = _features(x, o)
    if not len(f):
        return out, some
    key, c = np.unique(doc << BITS | f, return_counts=True)
    doc, f = key >> BITS, key & (FEATURES - 1)
    c = c.astype(np.float64)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    docs = doc[first]
    local = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(doc))))
    n = _sum_by(c, first)
    pf = model.p[f]
    single = _sum_by(c[:, None] * np.log(pf), first)
    pi, _ = _em(pf, c, local, first, n, np.full((len(first), L), 1 / L), ROUNDS)
    # nested sets: the k languages of largest proportion, k = 1, 2, ...
    order = np.argsort(-pi, axis=1, kind="stable")
    best = np.argmax(single, axis=1)
    chosen = np.zeros_like(pi)
    chosen[np.arange(len(first)), best] = 1.0
    at_ll = single[np.arange(len(first)), best]
    penalty = 0.5 * np.log(np.maximum(n, 2)) * OVERLAP
    live = np.flatnonzero(np.ones(len(first), bool)) if L > 1 else np.zeros(0, np.int64)
    for k in range(2, L + 1):
        live = live[pi[live, order[live, k - 1]] > 0.01]
        if not len(live):
            break
        pick_rows = np.isin(local, live)
        back = np.full(len(first), -1)
        back[live] = np.arange(len(live))
        l2 = back[local[pick_rows]]
        start = np.zeros((len(live), L))
        for j in range(k):
            start[np.arange(len(live)), order[live, j]] = np.maximum(pi[live, order[live, j]], 1e-3)
        start /= start.sum(1, keepdims=True)
        p2, ll2 = _em(pf[pick_rows], c[pick_rows], l2, np.flatnonzero(np.diff(l2, prepend=-1)), n[live], start, ROUNDS)
        better = ll2 - at_ll[live] > penalty[live]
        won = live[better]
        chosen[won], at_ll[won] = p2[better], ll2[better]
        live = won
    out[docs], some[docs] = chosen, True
    return out, some


_ASCII_LETTER = np.zeros(256, np.int64)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = 1


def _has_letter(x: np.ndarray, o: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(_ASCII_LETTER[x[o[0] : o[-1]]])])
    r = o - o[0]
    some = c[r[1:]] > c[r[:-1]]
    for i in np.flatnonzero(~some & (np.diff(o) > 0)).tolist():
        some[i] = any(ch.isalpha() for ch in x[o[i] : o[i + 1]].tobytes().decode("utf-8", "replace"))
    return some


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` (string), ``score`` (0 to 1) and ``lang_mix`` (map of language to proportion).

    ``und`` with score 0 if the text is null or has no letter, or nothing was
    learned.  A text with a letter but no trigram gets the commonest language
    at score 1/languages.  Equal proportions go to the language that sorts
    first.  Only the text decides; whole texts are read; repeats agree.  Other columns stay, but for those
    whose names clash.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)  # languages x FEATURES numbers

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        m = shared.value
        x, o = text_bytes(b.column(0))
        if not len(m.langs):
            mix, some = np.zeros((b.num_rows, 1)), np.zeros(b.num_rows, bool)
            letter = some
        else:
            parts = [proportions(x, o[i : j + 1], m) for i, j in _slabs(o)] or [(np.zeros((0, len(m.langs))), np.zeros(0, bool))]
            mix, some = (np.concatenate(z) for z in zip(*parts))
            letter = _has_letter(x, o) if b.num_rows else some
        lang, score, shares = [], [], []
        top, val = mix.argmax(1), mix.max(1)
        for i in range(b.num_rows):
            if not letter[i]:
                lang.append("und")
                score.append(0.0)
                shares.append([])
            elif not some[i]:
                lang.append(m.langs[m.first])
                score.append(1.0 / len(m.langs))
                shares.append([])
            else:
                lang.append(m.langs[top[i]])
                score.append(float(min(1.0, val[i])))
                shares.append([(m.langs[l], float(mix[i, l])) for l in np.flatnonzero(mix[i] > 0)])
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_mix", T.MapType(T.StringType(), T.DoubleType()))]
    return add_columns(unclash(docs, ["text"], [f.name for f in fields]), fields, make, ["text"])
