"""The training-data operators against brute force, libraries, and odd rows."""

import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nasaq.llm import bpe, decontaminate, language_id, near_dedup, pii, ppm, pretokens, queries, token_counts, token_store, topk, url_filter
from nasaq.llm.components import connected_components
from nasaq.llm.words import shingles, word_hashes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " \n\t ", "a", "a b", "Aa aA", "it's I'll  two   spaces\n\nand\r\nlines ", "\u0645\u0631\u062d\u0628\u0627 \U0001f600 caf\u00e9", "x" * 3000, "ab " * 3000, "<|endoftext|> in <|endoftext|>", "\0zero \1 one", "same text here", "same text here"]


def frame(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def clash(df):
    """Extra columns whose names clash."""
    return df.select("*", F.lit("?").alias("Text"), F.lit(1).alias("ids"), F.lit("x").alias("score"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def words_of(t):
    t = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    return re.findall("[^\x20\x09-\x0d]+", t)


# 1: byte-level BPE


def tiktoken_library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.pattern(), mergeable_ranks=bpe.load_ranks(bpe.vocabulary_path()), special_tokens={})


def test_bpe_equals_the_library(spark, docs):
    lib = tiktoken_library()
    for df in (docs, frame(spark, ODD)):
        got = {r.doc_id: r for r in bpe.round_trip(df).collect()}
        for r in df.collect():
            ids = lib.encode_ordinary(r.text or "")
            assert got[r.doc_id].n_tokens == len(ids)
            assert got[r.doc_id].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
            assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_bpe_columns_and_empty(spark):
    df = bpe.decode(bpe.encode(frame(spark, ODD)))
    for r in df.collect():
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.round_trip(frame(spark, [])).count() == 0
    assert bpe.round_trip(clash(frame(spark, ODD))).count() == len(ODD)


def test_merges_by_brute_force():
    ranks = bpe.load_ranks(bpe.vocabulary_path())

    def slow(b):
        parts = [b[i : i + 1] for i in range(len(b))]
        while True:
            best = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1)) if len(parts) > 1 else (1 << 30, 0)
            if best[0] == 1 << 30:
                return [ranks[p] for p in parts]
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(1)
    for _ in range(400):
        b = bytes(rng.choice(b"aeinorst \xc3\xa9lhd") for _ in range(rng.randint(1, 40)))
        assert bpe.merge_bytes(b, ranks) == slow(b)


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(5000)]
    p = bpe.PerfectHash(keys, list(range(5000)))
    assert len(p.keys) == 5000 and all(p.get(k) == i for i, k in enumerate(keys))
    assert p.get(b"no") is None and bpe.PerfectHash([], []).get(b"x") is None


# 2: language


def test_language_held_out_accuracy(spark):
    rows = queries.op2_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_mixture_and_odd_rows(spark, docs):
    model = language_id.train(docs)
    en = " ".join(r.text for r in docs.where("lang = 'en'").limit(20).collect())[:6000]
    fr = " ".join(r.text for r in docs.where("lang = 'fr'").limit(20).collect())[:6000]
    out = {r.doc_id: r for r in language_id.predict(clash(frame(spark, [en + " " + fr, *ODD, "12 34 !!"])), model).collect()}
    assert set(out[0].lang_mix) >= {"en", "fr"} and 0.3 < out[0].lang_mix["en"] < 0.7
    assert out[1].lang_pred == "und" and out[2].lang_pred == "und" and out[len(ODD) + 1].lang_pred == "und"
    assert out[4].lang_pred in model.langs  # a letter but no trigram
    assert language_id.predict(frame(spark, []), model).count() == 0
    none = language_id.train(frame(spark, ["x"], None))
    assert [r.lang_pred for r in language_id.predict(frame(spark, ["some text"]), none).collect()] == ["und"]


# 3: language model


def slow_ppm(train, texts, order):
    """PPM of the textbook: counts in dicts, exclusion by sets, method D."""
    tables = [{} for _ in range(order + 1)]
    for s in train:
        x = b"\n" * order + s
        for i in range(order, len(x)):
            for j in range(order + 1):
                t = tables[j].setdefault(x[i - j : i], Counter())
                t[x[i]] += 1
    out = []
    for s in texts:
        x, lp = b"\n" * order + s, 0.0
        for i in range(order, len(x)):
            gone: set = set()
            for j in range(order, -1, -1):
                t = tables[j].get(x[i - j : i])
                if t is None:
                    continue
                left = {k: v for k, v in t.items() if k not in gone}
                total = sum(left.values())
                if x[i] in left:
                    lp += math.log10((left[x[i]] - 0.5) / total)
                    break
                if left:
                    lp += math.log10(0.5 * len(left) / total)
                gone |= set(t)
            else:
                lp -= math.log10(256 - len(gone))
        out.append(lp)
    return out


def test_ppm_by_brute_force(spark, docs):
    some = docs.orderBy("doc_id").limit(25).collect()
    texts = [r.text[:600] for r in some] + ODD
    df = frame(spark, texts)
    held = F.col("doc_id") % 3 == 1
    got = {r.doc_id: r for r in ppm.score(clash(df), held).collect()}
    norm = [ppm.normalise(t) for t in texts]
    train = [s for i, s in enumerate(norm) if i % 3 != 1]
    want = slow_ppm(train, norm, ppm.ORDER)
    c = Counter(w for s in train for w in [*s[:-1].split(b" "), b"\n"] if w)
    n, v = sum(c.values()), len(c)
    for i, s in enumerate(norm):
        toks = [w for w in [*s[:-1].split(b" "), b"\n"] if w]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(toks), sum(t in c for t in toks), n, i % 3 == 1)
        assert toks == [w.encode() for w in words_of(texts[i])] + [b"\n"]
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in toks))
        assert r.score == pytest.approx(want[i])


def test_ppm_without_training(spark):
    assert ppm.score(frame(spark, []), F.lit(False)).count() == 0
    (r,) = ppm.score(frame(spark, ["ab"]), F.lit(True)).collect()
    assert r.score == pytest.approx(-3 * math.log10(256)) and r.train_tokens == 0 and r.n_known == 0


# 4: decontamination


def grams(text, w):
    x = words_of(text)
    w = min(w, len(x))
    return {tuple(x[i : i + w]) for i in range(len(x) - w + 1)} if x else set()


def test_decontamination_by_brute_force(spark):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 400)}" for _ in range(4000)]
    items = [(i, " ".join(base[i * 60 : i * 60 + rng.choice([1, 3, 5, 8, 30, 55])])) for i in range(40)] + [(90, ""), (91, "Same CASE here for you now ok"), (92, None)]
    texts = []
    for i in range(60):
        t = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([0, 10, 300]))]
        w = (items[rng.randint(0, 39)][1] or "").split()
        for _ in range(rng.randint(0, 2)):
            if w:
                w[rng.randint(0, len(w) - 1)] = "edit"
        texts.append(" ".join(t + w + t[:50]))
    texts += ["xx same case here for you now ok yy", *ODD]
    df = clash(frame(spark, texts))
    out = {r.doc_id: r for r in decontaminate.find_items(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = {}
        for k, it in items:
            s = grams(it, 5)
            if s:
                w = len(next(iter(s)))
                x = words_of(t)
                d = {tuple(x[j : j + w]) for j in range(len(x) - w + 1)}
                if len(s & d) / len(s) >= 0.8:
                    want[k] = len(s & d) / len(s)
        assert out[i].item_ids == sorted(want)
        assert out[i].containment == pytest.approx(max(want.values(), default=0.0))


def test_decontamination_in_slices(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = decontaminate.find_items(docs, items).select("doc_id", "item_ids").collect()
    many = decontaminate.find_items(docs, items, max_bytes=2000).select("doc_id", "item_ids").collect()
    assert sorted(one) == sorted(many) and any(r.item_ids for r in one)
    none = decontaminate.find_items(docs, items.limit(0)).where(F.size("item_ids") > 0)
    assert none.count() == 0


# 5: token counts


def library():
    return token_counts.library(bpe.vocabulary_path("byte_bpe_50k.json"))


def test_token_counts_equal_the_library(spark, docs):
    lib = library()
    for df in (docs, frame(spark, ODD)):
        got = {r.doc_id: r for r in token_counts.count_tokens(df).collect()}
        assert len(got) == df.count()
        for r in df.collect():
            n = len(lib.encode(r.text or "", add_special_tokens=False).ids)
            assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len((r.text or "").encode()), n > 1024)


def test_token_counts_odd_tables(spark, monkeypatch):
    assert token_counts.count_tokens(frame(spark, [])).count() == 0
    df = spark.createDataFrame([(None, "a b"), (1, None), (1, "x"), (1, "x")], "doc_id long, text string")
    rows = sorted((r.doc_id or -1, r.n_tokens) for r in token_counts.count_tokens(clash(df)).collect())
    assert rows == [(-1, 2), (1, 0), (1, 1), (1, 1)]


# 6: near duplicates


def slow_groups(texts, width, percent):
    sets = [grams(t, width) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("width,hot", [(2, near_dedup.HOT), (5, near_dedup.HOT), (2, 2), (5, 2)])
def test_near_dedup_by_brute_force(spark, monkeypatch, width, hot):
    monkeypatch.setattr(near_dedup, "HOT", hot)  # at 2 all that isn't settled by stars meets by changes to a hub
    rng = random.Random(width)
    texts = list(ODD)
    for size in (3, 6, 12, 60, 79, 90, 130, 400):
        base = [f"w{rng.randint(0, 300)}" for _ in range(size)]
        for _ in range(14):
            t = list(base)
            for _ in range(rng.randint(0, max(1, size // 14))):
                t[rng.randint(0, len(t) - 1)] = f"e{rng.randint(0, 50)}"
            texts.append(" ".join(t))
    want, sizes = slow_groups(texts, width, 80)
    got = {r.doc_id: r for r in near_dedup.groups(clash(frame(spark, texts)), width=width).collect()}
    for i in range(len(texts)):
        assert (got[i].component_id, got[i].n_shingles, got[i].kept) == (want[i], sizes[i], want[i] == i)


def test_near_dedup_keeps_sketches_and_signatures_in_place(spark, monkeypatch):
    """They are most of a row: only those of sets that pair up are staged again or dealt out, also where ids aren't broadcast."""
    rnd, staged = random.Random(6), {}
    real = near_dedup.stage
    monkeypatch.setattr(near_dedup, "stage", lambda df, name: staged.setdefault(name, real(df, name)))
    monkeypatch.setattr(near_dedup, "_FEW_IDS", 0)
    texts = [" ".join(rnd.choices("abcdefghijklmnop", k=120)) for _ in range(12)]
    texts += [texts[0] + " z", texts[0], texts[5] + " y x"]
    got = {r.doc_id: r.component_id for r in near_dedup.groups(frame(spark, texts), width=2).collect()}
    assert got == {i: i for i in range(12)} | {12: 0, 13: 0, 14: 5}
    assert [n for n, df in staged.items() if "sketch" in df.columns] == ["near-sketches"]
    assert staged["near-lists"].schema["a"].dataType.names == ["id", "n"]


def test_near_dedup_lists_rare_shingles_and_confirms_on_texts(spark, monkeypatch):
    """A phrase that many short texts share gives no list, and sets of pairs are neither staged nor dealt out."""
    rnd, types, listed, real = random.Random(7), {}, set(), near_dedup.stage

    def stage(df, name):
        out, types[name] = real(df, name), dict(df.dtypes)
        if name == "near-lists":
            listed.update(r.a.id for r in out.collect())
        return out

    monkeypatch.setattr(near_dedup, "stage", stage)
    phrase = "this line is in every one of the texts"
    texts = [" ".join([phrase, *(f"w{rnd.randint(0, 10**9)}" for _ in range(9))]) for _ in range(60)]
    apart = len(texts)
    texts += [f"{texts[0]} z", f"{texts[7]} z", ""]
    want, sizes = slow_groups(texts, 2, 80)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_dedup.groups(frame(spark, texts), width=2).collect()}
    assert got == {i: (want[i], sizes[i]) for i in range(len(texts))}
    assert listed == {0, 7, apart, apart + 1}
    assert not [n for n, t in types.items() if n.startswith(("near-star", "near-cross")) and "s" in t]


def test_near_dedup_has_one_python_worker_a_task(spark, monkeypatch):
    # two Python maps in one task take two workers, which stay and hold what later tasks leave in them
    monkeypatch.setattr(near_dedup, "HOT", 2)
    kind, below = type(spark.range(0)), []
    real = kind.mapInArrow

    def map_in_arrow(df, *a, **b):
        below.append("MapInArrow" in df._jdf.queryExecution().analyzed().toString())
        return real(df, *a, **b)

    monkeypatch.setattr(kind, "mapInArrow", map_in_arrow)
    texts = [f"a b c d e f g h i j k l m n o p q r s t {x} {y}" for x in "uvw" for y in "xyz"] + ["", None, "a b"]
    assert near_dedup.groups(frame(spark, texts), width=2).where("doc_id = component_id").count() == 4
    assert len(below) > 5 and not any(below)


def test_near_dedup_odd_tables(spark):
    assert near_dedup.groups(frame(spark, [])).count() == 0
    assert all(r.kept for r in near_dedup.groups(frame(spark, ["", None, " "])).collect())


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150), (300, 300)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 200: 100, 150: 100}


# 7: token store


def test_token_store_round_trip(spark, docs):
    lib = library()
    for df in (docs, frame(spark, ODD)):
        rows = sorted(token_store.store(clash(df)).collect())
        at = 0
        for r, d in zip(rows, sorted(df.collect(), key=lambda d: d.doc_id), strict=True):
            ids = [*lib.encode(d.text or "", add_special_tokens=False).ids, 0]
            assert (r.doc_id, r.start, r.n_tokens) == (d.doc_id, at, len(ids))
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
            at += len(ids)
    assert token_store.store(frame(spark, [])).count() == 0


def test_token_store_null_and_repeated_ids(spark):
    lib, text = library(), ["b", None, "a a", "a a", "never", "a a"]
    df = spark.createDataFrame([(3, text[0]), (3, text[1]), (3, text[2]), (1, text[3]), (None, text[4]), (3, text[5])], "doc_id long, text string")
    rows = sorted(token_store.store(df).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [1, 3, 3, 3, 3]
    size = {t: len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for t in text}
    assert sorted(r.n_tokens for r in rows[1:]) == sorted(size[t] for t in ("b", None, "a a", "a a"))
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab\u00e9\u4e2d'stremvld  \n\t\u0085\x1c\u00a0\u3000019\u0661\u00b2.,-\u0301\U0001f600_")), max_size=6))
def test_pre_tokens_equal_the_pattern(texts):
    texts = [*texts, "it's 'll we'll 'llama ''s !'s x's's \u0645'd", "<|endoftext|>'s<|endoftext|>", ""]
    c = pretokens.Cutter(bpe.pattern(), ["<|endoftext|>"])
    joined, _, starts, count = c.cut(texts)
    words = [joined[a:b] for a, b in zip(starts, [*starts[1:], len(joined)])]
    assert bpe.pattern() == pretokens.KNOWN
    assert words == [w for t in texts for w in token_counts.pre_tokens(t, c.find, c.first) if w] and sum(count) == len(words)


def test_long_texts_are_cut_where_nothing_changes(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["ab", " ", "c", "'s", "  ", "\n", "1", "!", "\u00e9"]) for _ in range(rng.randint(0, 900))) for _ in range(30)]
    m = pretokens.Memory(pretokens.Cutter(bpe.pattern(), []), lambda ws: [np.array([ord(c) for c in w] + [7], "<u4") for w in ws], "<u4", 1000)
    want = m.encode(texts, end=9)
    monkeypatch.setattr(pretokens, "SLICE", 50)
    got = m.encode(texts, end=9)
    assert all(np.array_equal(a, b) for a, b in zip(got, want)) and len(m.cutter.pieces(texts[0] + " ab ab" * 50)) > 2


def test_memory_forgets_and_tells_equal_hashes_apart(monkeypatch):
    asked = []

    def ask(words):
        asked.extend(words)
        return [np.array([ord(c) for c in w], "<u4") for w in words]

    rng = random.Random(4)
    texts = ["".join(rng.choice("ab c\n1'") for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["x" * 200, "y" * 64 + " " + "x" * 200]
    for most, weak in ((50, False), (10_000, True)):
        if weak:  # the first hash tells nothing
            monkeypatch.setattr(pretokens, "hashes", lambda *a, f=pretokens.hashes: (f(*a)[0] & np.uint64(3), f(*a)[1]))
        m = pretokens.Memory(pretokens.Cutter(bpe.pattern(), []), ask, "<u4", most)
        for s in range(0, len(texts), 50):
            own = texts[s : s + 50]
            ids, n = m.encode(own, end=7)
            assert ["".join(map(chr, x[:-1])) for x in np.split(ids, np.cumsum(n)[:-1])] == own and set(ids[np.cumsum(n) - 1].tolist()) == {7}
    assert len(asked) > len(set(asked))


def test_packed_misses_equal_single_ones(docs):
    lib = token_store._Library(bpe.vocabulary_path(token_store.VOCABULARY), bpe.pattern())
    texts = [r.text or "" for r in docs.collect()] + [t or "" for t in ODD] + ["x \u0661 \u00aa\u00ba \u01c5ab\u02b0 \u4e2d\u6587 na\u00efve <|endoftext|> it's  two\u0085 \x1c\n\n end "]
    ids, n = lib.encode(texts)
    for t, got in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert got.tolist() == library().encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("block", [64, 1024, token_store.BLOCK])
def test_wavelet_matrix_by_brute_force(monkeypatch, block):
    monkeypatch.setattr(token_store, "BLOCK", block)
    monkeypatch.setattr(token_store, "OPEN_BLOCKS", 8)
    rng = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 1), (700, 50), (3000, 50257), (900, 1 << 20)):
        x = rng.integers(0, top, n).astype(np.uint32)
        s = token_store.Shard(token_store.write_shard(np.array([7]), np.array([n]), x))
        assert np.array_equal(s.sequence(), x) and s.n == n
        if n:
            assert np.array_equal(s.access(np.arange(n)), x)
            for v in {int(x[0]), int(x[-1]), top + 5}:
                at = np.flatnonzero(x == v)
                assert s.rank(v, n // 2) == (at < n // 2).sum() and s.rank(v, n) == len(at)
                for k in range(min(len(at), 5)):
                    assert s.select(v, k) == at[k]
                assert s.select(v, len(at)) == -1


def test_wavelet_unpacks_few_blocks(monkeypatch):
    x = np.random.default_rng(2).integers(0, 1 << 16, 1 << 20).astype(np.uint32)
    s, seen = token_store.Shard(token_store.write_shard(np.array([7]), np.array([len(x)]), x)), []
    monkeypatch.setattr(s, "_blob", lambda i, f=s._blob: seen.append(i) or f(i))
    assert s.access([12345]).tolist() == [int(x[12345])]
    assert len(seen) == s.levels and s.blocks == 8


# 8: personal data


def slow_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text, re.A):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        s = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and s % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_pii_base_by_brute_force(spark, docs):
    rng = random.Random(5)
    pieces = ["a.b@c.de", "@", "..", "x_y@z-w.co.uk", "1.2.3.4", "300.1.1.1", "0001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "5", " ", "  ", "-", "+1 (555) 123-4567", "+12", "é", "\U0001f600", "12345678901234", "word", "\n", "4222222222222", ".", "+", "a@b", "%"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(500)]
    texts += ["1 " * 30000, "1" * 50000, "a" * 100000 + "@", "a@" + "b." * 20000 + "c", "1." * 30000, "+1" + "(" * 50000, *(t or "" for t in ODD)]
    texts += [r.text for r in docs.collect()]
    got = {r.doc_id: r for r in pii.report(clash(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = slow_base(t)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x[0] for x in want) for k in ("email", "ip", "card", "phone")), t[:200]
        joined = ",".join(f"{a}:{b}:{c}" for a, b, c in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), t[:200]
        assert r.spans.startswith(joined)


@pytest.mark.parametrize("few", [pii.FEW_BYTES, -1])
def test_pii_terms_and_redaction(spark, monkeypatch, few):
    monkeypatch.setattr(pii, "FEW_BYTES", few)  # broadcast, or shuffled
    texts = ["Write to Zebulon Quartermaine at zq@mail.example.com today please"] * 4 + ["nothing to see here today please"] * 200 + [None, ""]
    df = frame(spark, texts)
    rows = {r.doc_id: r.text for r in pii.sanitise(clash(df)).collect()}
    assert rows[0] == "<TERM> to <TERM> <TERM> at <EMAIL> today please"
    assert rows[10] == texts[10] and rows[204] is None and rows[205] == ""
    over = frame(spark, ["call +4111 1111 1111 1111 x@1.2.3.4 end"])
    assert pii.sanitise(over).first().text == "call +<CARD> <EMAIL> end"
    assert pii.report(frame(spark, [])).count() == 0


def test_pii_entity_of_one_document(spark):
    texts = ["Write to Zebulon Quartermaine at zq@mail.example.com today please"] + ["nothing to see here today please"] * 200
    rows = {r.doc_id: r.text for r in pii.sanitise(frame(spark, texts)).collect()}
    assert rows[0] == "<TERM> to <TERM> <TERM> at <EMAIL> today please" and rows[1] == texts[1]


def slow_terms(texts):
    """Spans of terms that disclose an entity, by the definition."""
    n, words, entities = len(texts), [], []
    for t in texts:
        words.append({w.lower() for w in regex.findall(r"\p{L}+", t) if len(w) >= pii.TERM_LETTERS})
        entities.append({(k, t[a:b].lower() if k in ("email", "ip") else re.sub("[^0-9]", "", t[a:b])) for k, a, b in slow_base(t)})
    n_term, n_entity = Counter(w for x in words for w in x), Counter(e for x in entities for e in x)
    both = Counter((e, w) for x, y in zip(entities, words) for e in x for w in y)
    bad = {w for (e, w), k in both.items() if n_entity[e] < n and math.log2(k * n / (n_term[w] * n_entity[e])) >= pii.DISCLOSURE * math.log2(n / n_entity[e])}
    out = []
    for t in texts:
        base = slow_base(t)
        out.append([m.span() for m in regex.finditer(r"\p{L}+", t) if m.group().lower() in bad and not any(a <= m.start() and m.end() <= b for _, a, b in base)])
    return out


@pytest.mark.parametrize("few", [pii.FEW_BYTES, -1])
def test_pii_terms_by_brute_force(spark, monkeypatch, docs, few):
    monkeypatch.setattr(pii, "FEW_BYTES", few)
    far = "Zebulon Quartermaine wrote. " + "nothing to see here today please " * 30
    texts = [far + "Reach him at zq@mail.example.com or 10.1.2.3. Or ask QUARTERMAINE", "here zebulon is on his own, today", *["nothing to see here today please"] * 60]
    rng = random.Random(8)
    rare = ["\U0001f600", "caf\u00e9s", "\u0645\u0631\u062d\u0628\u0627", *(f"word{c}" for c in "abcdefghijkl")]
    for i in range(120):
        who = rng.choice(["", "", f"u{i % 7}@ex.org", "8.8.8.8", "+1 (555) 123-4567", "4111 1111 1111 1111"])
        texts.append(" ".join([*rng.choices(rare, k=rng.randint(0, 6)), who, *rng.choices(rare, k=3)]))
    texts += [texts[0], texts[70], *(r.text or "" for r in docs.collect())]
    got = {r.doc_id: r for r in pii.find(clash(frame(spark, texts))).collect()}
    want = slow_terms(texts)
    for i, t in enumerate(texts):
        assert [(x.s, x.e) for x in got[i].spans if x.kind == 4] == want[i], t[:200]
        assert all(t[x.s : x.e] == x.v for x in got[i].spans)
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, texts)).collect()}
    assert clean[1] == "here <TERM> is on his own, today"
    assert clean[0].startswith("<TERM> <TERM> <TERM>. nothing to see here") and clean[0].endswith("<EMAIL> or <IP>. Or ask <TERM>")


def test_pii_many_matches_in_one_text(spark):
    n = 100_000
    text = "".join(f"u{i % 7}@e.org " for i in range(n))
    began = time.time()
    r = pii.report(frame(spark, [text])).select("n_email", "base_sha256").first()
    want = ",".join(f"email:{i * 9}:{i * 9 + 8}" for i in range(n))
    assert r.n_email == n and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert pii.sanitise(frame(spark, [text])).first().text == "<EMAIL> " * n
    assert time.time() - began < 60


def test_pii_plan_is_native(spark, docs):
    plan = pii.find(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 9: URLs


def test_url_filter_by_brute_force(spark):
    rules = [("net", "/", "block"), ("a.net", "/en/", "allow"), ("a.net", "/en/x", "block"), ("com", "", "block"), ("b.com", "/q", "allow"), ("b.com", "/q/r/s", "block")]
    rng = random.Random(2)
    urls = [None, "", "nohost", "http://", "HTTP://A.NET", "http://net/", "x://y://z.net/"]
    for _ in range(400):
        urls.append("http://" + ".".join(rng.choice(["a", "b", "www", "NET", "com", "net"]) for _ in range(rng.randint(1, 4))) + "".join(rng.choice(["/", "/en/", "en", "/q", "/q/r/s", "x", "?a=/", "#", "/x"]) for _ in range(rng.randint(0, 4))))

    def slow(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        host, path = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1]).groups()
        host = host.lower()
        fit = [(len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[2:] if fit else (None, "allow")))

    df = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    for most in (1 << 20, 12):
        got = {r.page_id: tuple(r)[1:] for r in url_filter.judge(df, rules, max_bytes=most).collect()}
        for i, u in enumerate(urls):
            assert got[i] == slow(u), u
    assert url_filter.judge(df.limit(0)).count() == 0


# 10: top-k


def test_topk_by_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.2, 16).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # many ties
    rows += [(2000, None), (2050, [None, 1.0]), (2100, [float("nan")] * 16), (2150, [1.0, 2.0]), (2200, []), (2250, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ok = {i: np.floor(256 * np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()}
    for block in (64, 4096):
        out = topk.top_k(df, df.where("vec_id % 50 = 0"), k=5, query_block=7 if block == 64 else 1024, candidate_block=block)
        got = {}
        for r in out.collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        for q in (i for i in ok if i % 50 == 0):
            s = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:5]
            assert sorted(got.get(q, [])) == [(k + 1, i, -n) for k, (n, i) in enumerate(s)]
        assert set(got) <= {i for i in ok if i % 50 == 0}
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


# kernels and the pipeline


def test_topk_repeated_rows_and_clashing_names(spark, tmp_path):
    rows = [(0, [0.0]), (0, [0.0]), (1, [1.0]), (2, [2.0]), (2, [2.0]), (50, [3.0]), (50, [-3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), k=4, query_block=1).collect())
    # 50 counts as the query -3; a query's own rows are no candidates
    want = [(0, 1, 1, 0), (0, 2, 2, 0), (0, 3, 2, 0), (0, 4, 50, 0), (50, 1, 0, 0), (50, 2, 0, 0), (50, 3, 1, -768 * 256), (50, 4, 2, -768 * 512)]
    assert got == want
    assert got == sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), k=4, query_block=1, slice_bytes=1).collect())
    spark.createDataFrame([(i, [float(i)], -i) for i in range(120)], "vec_id long, embedding array<float>, `EMBEDDING_` long").write.parquet(str(tmp_path / "embeddings.parquet"))
    clashing = spark.read.parquet(str(tmp_path / "embeddings.parquet")).withColumnRenamed("EMBEDDING_", "VEC_ID")
    assert topk.top_k(clashing, clashing).count() == 120 * 5 and topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_topk_skips_products():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 60, (40, 32))
    x = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 8, (4000, 32)))
    by, starts = topk.tiled(x)
    x = x[by]
    ids, q = np.arange(4000), np.arange(0, 4000, 50)
    score = x[q] @ x.T
    score[np.arange(len(q)), q] = -np.inf
    want = {(int(a), int(v)) for a, row in zip(q, score) for v in np.argsort(-row, kind="stable")[:5]}
    _, _, s = topk.gather(q, x[q], ids, x, starts, 5, 4)
    cut = s.reshape(-1, 5)[:, 4].astype(float)
    assert (cut <= np.sort(score, axis=1)[:, -5]).all()
    (hq, hv, _), made = topk.resolve(q, x[q], ids, x, starts, cut, 5, 4)
    assert set(zip(hq.tolist(), hv.tolist())) == want
    print(made / (len(q) * x.size))
    assert made < 0.25 * len(q) * x.size  # products made, of those without the cutoff


def test_topk_large_components():
    x = np.floor(np.random.default_rng(6).normal(0, 2**27, (150, 8)))
    x = x[topk.tiled(x)[0]]
    ids = np.arange(150)
    (hq, hv, hs), _ = topk.resolve(ids[:3], x[:3], ids, x, topk.tiled(x)[1], np.full(3, -np.inf), 2, 4)
    for i in range(3):
        every = sorted(((-sum(int(a) * int(b) for a, b in zip(x[i], y)), j) for j, y in enumerate(x) if j != i))[:2]
        assert [(-int(a), int(b)) for a, b in zip(hs[hq == i], hv[hq == i])] == every


def thue_morse(n, a, b):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def test_long_words_of_few_letters_are_told_apart(spark):
    one, two = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    x = np.frombuffer(f"{one} {two}".encode(), np.uint8)
    for lane in (0, 1):
        h, _ = word_hashes(x, np.array([0, len(x)], np.int64), lane)
        assert len(set(h.tolist())) == 2
    rows = near_dedup.groups(frame(spark, [f"x {one} y", f"x {two} y", f"x {one} y"]), width=2).collect()
    assert {r.doc_id: r.component_id for r in rows} == {0: 0, 1: 1, 2: 0}
    items = spark.createDataFrame([(1, one)], "item_id long, text string")
    found = {r.doc_id: list(r.item_ids) for r in decontaminate.find_items(frame(spark, [f"x {one} y", f"x {two} y"]), items).collect()}
    assert found == {0: [1], 1: []}


def test_word_hashes_across_slabs(monkeypatch):
    from nasaq.llm import words

    texts = [(t or "") for t in ODD] + ["one two three four " * 50]
    enc = [t.encode() for t in texts]
    x = np.frombuffer(b"".join(enc), np.uint8)
    o = np.cumsum([0, *map(len, enc)])
    whole = word_hashes(x, o)
    monkeypatch.setattr(words, "SLAB", 17)
    parts = word_hashes(x, o)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])
    assert [len(words_of(t)) for t in texts] == np.diff(whole[1]).tolist()
    assert len(shingles(whole[0][:1], 2)) == 0


def test_pipeline_decisions(spark, tmp_path):
    import corpus_pipeline as c

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300)
    sf = "/root/testdata/sf0.01"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    more = frame(spark, ["123 456 !!", "Some words before " + item + " and after it", "mail me at a.b@c.de please and thank you"]).withColumn("doc_id", F.col("doc_id") + 10_000_000)
    first = docs.where("length(text) > 500").orderBy("doc_id").limit(1).withColumn("doc_id", F.lit(20_000_000).cast("long"))
    step = docs.unionByName(more).unionByName(first)
    want = {r.doc_id: r.text for r in step.collect()}
    seen = []
    for k, (name, f) in enumerate(c.STAGES):
        out = f(spark, step, sf)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        step = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id for r in step.collect()})
    assert 10_000_000 not in seen[0] and 20_000_000 in seen[0] and 20_000_000 not in seen[1]
    assert 10_000_001 in seen[1] and 10_000_001 not in seen[2] and 10_000_002 in seen[3]
    clean = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "pii")).collect()}
    assert "<EMAIL>" in clean[10_000_002] and "a.b@c.de" not in clean[10_000_002]
    final = {r.doc_id: r for r in step.collect()}
    assert all(final[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in clean.items()) and want


def test_pipeline_near_copies_with_odd_ids(spark):
    import corpus_pipeline as c

    def text(tag, end=""):
        return " ".join(f"{tag}{i}" for i in range(60)) + end

    rows = [
        (1, text("a")), (5, text("a", " more")), (5, text("b")), (5, text("c")), (9, text("c")), (9, text("c")),  # 5 has a copy of 1 and two texts of its own
        (None, text("d")), (None, text("e")), (None, text("e")), (None, text("a")), (None, text("f")), (7, text("f", " more")),
        (None, ""), (None, ""), (None, None), (5, ""), (5, ""), (6, None),
    ]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    out = c.keep_one_of_each(spark, clash(df), "")
    want = [rows[i] for i in (0, 2, 3, 6, 7, 11, 12, 13, 14, 15, 17)]
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(want)
    unique = df.where("doc_id < 5 OR doc_id = 7")
    assert sorted(r.doc_id for r in c.keep_one_of_each(spark, unique, "").collect()) == [1, 7]
