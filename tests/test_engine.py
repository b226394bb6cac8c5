"""The search engine: keys, matchers, lines, selection, output, discovery, formats, streams."""

import json
import random
import re
import unicodedata
import zipfile
from dataclasses import replace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nasaq.functions import columns, translit
from nasaq.functions.explain import explain
from nasaq.functions.kernel import EmptyKeyError, map_span, marks, normalize, normalize_mapped, presentation_forms
from nasaq.functions.profile import OVERRIDES, PROFILES, SWITCHES, Profile, format_languages, parse_languages, resolve
from nasaq.operators import search as S
from nasaq.operators.matchers import Fuzzy, Literal, PatternError, Regex, build, translate_pattern
from nasaq.operators.prefilter import ANCHORS, anchors, must_match, proofs
from nasaq.operators.spans import highlight_column, mark, search_text
from nasaq.plans.command import run, search_files
from nasaq.plans.options import UsageError, parse
from nasaq.sources import decode, discover, formats
from nasaq.sources.lines import read_store, split_lines
from nasaq.streaming import search as stream

P = PROFILES["search"]
ALPHABET = "ابتثجحخدذرزسشصضطظعغفقكلمنهويىةءآأؤإئٱـًٌٍَُِّْٰٕٓٔۀکیہۭۖ۝ۥ٠٣۴،؛؟٪٫۔‌‍‎⁧ﻻﻛﺘﺎﺏﷺﹰ aZßİé́각"
texts = st.text(st.sampled_from(ALPHABET), max_size=24) | st.text(st.characters(exclude_categories=["Cs"]), max_size=12)
profiles = st.builds(lambda on, scope, langs: Profile(scope=scope, languages=frozenset(langs), **{s: True for s in on}), st.sets(st.sampled_from(SWITCHES)), st.sampled_from(("all", "harakat", "harakat+dagger")), st.sets(st.sampled_from(("ar", "fa", "ur", "ps", "ku", "ug")))) | st.sampled_from(list(PROFILES.values()))
deep = settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))


# keys


@pytest.mark.parametrize(
    "profile,text,key",
    [
        ("search", "اَلْعَرَبِيَّةُ", "العربيه"), ("search", "آأإٱ", "اااا"), ("search", "مسؤول فئة", "مسوول فيه"), ("search", "café", "cafe"), ("search", "َُِّْ", ""),
        ("strict", "اَلْعَرَبِيَّةُ", "العربية"), ("strict", "آأإٱ", "آأإٱ"), ("strict", "مسؤول فئة", "مسؤول فئة"),
        ("loose", "العــربية", "العرٮٮه"), ("loose", "مسؤول فئة", "مسوول ٯٮه"), ("loose", "على ٣؟", "علٮ 3?"),
        ("lucene", "آأإٱ", "اااٱ"), ("lucene", "مسؤول فئة", "مسؤول فئه"), ("lucene", "café", "café"),
        ("camel", "العــربية", "العــربيه"), ("camel", "آأإٱ", "اااا"), ("camel", "هٰذا", "هذا"),
    ],
)
def test_presets(profile, text, key):
    assert normalize(PROFILES[profile], text) == unicodedata.normalize("NFD", key)


@pytest.mark.parametrize(
    "languages,text,key",
    [("ar", "كک يی", "كک يی"), ("fa", "كک يی", "كک يی"), ("ar,fa", "كک يی", "كك يي"), ("ar,ur", "هہ ھ ے", "هه ھ ے"), ("ar,fa", "ہ", "ہ"), ("fa", "ۀ", "ه"), ("ar", "ۀ", "ە"), ("fa", "می‌روم‍", "می‌روم"), ("ar", "می‌روم", "میروم")],
)
def test_languages(languages, text, key):
    assert normalize(resolve("search", languages), text) == unicodedata.normalize("NFD", key)


def test_single_rules():
    one = lambda **k: lambda s: normalize(Profile(**k), s)
    assert one(digits=True)("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹") == "0123456789" * 2
    assert one(punctuation=True)("،٬؛؟٪٫۔") == ",,;?%.."
    assert one(bidi=True)("a؜‎‏‪‮⁦⁩b") == "ab"
    assert one(quranic=True)("aۖ۝۞ۥۭb") == "ab" and one(quranic=True)("ەۮ") == "ەۮ"
    assert one(tashkil=True)("aۖb") == "aۖb"  # the Quranic block goes before the vowel signs
    assert one(joiners=True)("a‌‍b") == "ab"
    assert one(rasm=True)("بتثنيجحخدذرزسشصضطظعغفق") == "ٮٮٮٮٮحححددررسسصصططععٯٯ"
    assert one(rasm=True)("ئ") == "ٮ" and one(hamza_seat=True)("ئؤ") == "يو"
    assert one(alef_hamza=True, tatweel=True, joiners=True)("ا‍ٔ") == "ا"  # a dropped joiner still carries
    assert one(alef_hamza=True)("بٔ") == "بٔ" and Profile() and one()("é") == "e\u0301"
    assert resolve("search", "ar", ("keep_hamza",)) == replace(P, alef_hamza=False, alef_wasla=False, hamza_seat=False)
    assert set(OVERRIDES) >= {"rasm", "fold_digits"} and format_languages(parse_languages(" ur, ar")) == "ar,ur"
    for bad in ("", "ar,", "xx"):
        with pytest.raises(ValueError):
            parse_languages(bad)
    with pytest.raises(ValueError):
        Profile(scope="none")


def test_presentation_table():
    t = presentation_forms()
    assert len(t) == 731 and t[0xFEFB] == "لا" and 0xFDFD not in t


@deep
@given(profiles, texts)
def test_key_is_idempotent_and_mapped_alike(p, s):
    k = normalize(p, s)
    assert normalize(p, k) == k
    key, index = normalize_mapped(p, s)
    assert key == k
    assert len(index) == len(key.encode()) + 1 and index[-1] == len(s.encode()) and index == sorted(index)


def slow_key(p, s):
    """The rules one by one, as they are told."""
    if p.presentation:
        s = "".join(presentation_forms().get(ord(c), c) for c in s)
    if "fa" in p.languages:
        s = s.replace("ۀ", "ه")
    out, last = [], ""
    for r in unicodedata.normalize("NFD", s):
        c, o, drop = ord(r), r, False
        if r in "ٕٓٔ" and last == "ا":
            drop = p.alef_hamza
        elif r == "ٔ" and last in ("و", "ي"):
            drop = p.hamza_seat or (p.rasm and last == "ي")
        elif r == "ـ":
            drop = p.tatweel
        elif r in "کی" and p.crosses_arabic:
            o = {"ک": "ك", "ی": "ي"}[r]
        elif r == "ہ" and {"ar", "ur"} <= p.languages:
            o = "ه"
        elif r in "ٱةى":
            on, to = {"ٱ": (p.alef_wasla, "ا"), "ة": (p.ta_marbuta, "ه"), "ى": (p.alef_maksura, "ي")}[r]
            o = to if on else r
        elif c == 0x200C:
            drop = p.joiners and not p.keeps_zwnj
        elif c == 0x200D:
            drop = p.joiners
        elif c in (0x61C, 0x200E, 0x200F) or 0x202A <= c <= 0x202E or 0x2066 <= c <= 0x2069:
            drop = p.bidi
        elif 0x6D6 <= c <= 0x6ED:
            drop = p.quranic
        elif p.digits and (0x660 <= c <= 0x669 or 0x6F0 <= c <= 0x6F9):
            o = str(c & 15)
        elif r in "،٬؛؟٪٫۔":
            o = dict(zip("،٬؛؟٪٫۔", ",,;?%.."))[r] if p.punctuation else r
        elif not 0x660 <= c <= 0x669:
            drop = p.tashkil and c in marks(p.scope)
        canonical = o
        if p.rasm and not drop:
            o = {c: k for k, v in {"ٮ": "بتثني", "ح": "جخ", "د": "ذ", "ر": "ز", "س": "ش", "ص": "ض", "ط": "ظ", "ع": "غ", "ٯ": "فق"}.items() for c in v}.get(o, o)
        if not drop and canonical in "اوي":
            last = canonical
        elif not (last and (drop or unicodedata.category(r) == "Mn")):
            last = ""
        if not drop:
            out.append(o)
    return unicodedata.normalize("NFD", "".join(out))


@deep
@given(profiles, texts)
def test_key_by_brute_force(p, s):
    assert normalize(p, s) == slow_key(p, s)


def test_map_span():
    key, index = normalize_mapped(P, "ﻻ x")
    assert key == "لا x" and map_span(index, 0, 2) == (0, 3) and map_span(index, 2, 4) == (0, 3)
    assert map_span(index, 0, 0) == (0, 0) and map_span(index, 3, 99) == (0, 0) and map_span([], 0, 0) == (0, 0)


def test_native_keys_equal_the_kernel(spark):
    rng = random.Random(0)
    rows = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 20))) for _ in range(1500)] + ["", "plain ascii", "Straße é", None]
    rows += [chr(c) for c in range(0xA0, 0x3000) if unicodedata.category(chr(c)) != "Cn"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").repartition(4).cache()
    for p in [*PROFILES.values(), resolve("search", "ar,fa"), resolve("loose", "fa"), resolve("search", "ar,ur", ("keep_joiners",)), resolve("search", "ar", ("keep_hamza",)), Profile()]:
        for r in df.select("i", columns.key_column(F.col("t"), p).alias("k")).collect():
            assert r.k == (None if rows[r.i] is None else normalize(p, rows[r.i])), (p, rows[r.i])


def test_native_plan_has_no_python(spark):
    df = spark.createDataFrame([("Élan",)], "t string").select(columns.key_column(F.col("t"), P, "native").alias("k"))
    assert df.first().k == "Elan" and "Python" not in df._jdf.queryExecution().executedPlan().toString()
    bad = spark.createDataFrame([("각",)], "t string").select(columns.key_column(F.col("t"), P, "native").alias("k"))
    with pytest.raises(Exception, match="full decomposition"):
        bad.collect()


def test_explain(spark):
    key, rules = explain("مَكْتَبَةٌ", "search", "ar")
    assert key == "مكتبه" and rules == ["tashkil", "ta marbuta"]
    assert explain("é")[1] == ["Unicode NFD", "tashkil"]
    with pytest.raises(ValueError):
        explain("x" * 40000)
    r = spark.createDataFrame([("ﻻ",), (None,)], "t string").select(columns.explain_column(F.col("t")).alias("e")).collect()
    assert r[0].e.rules == ["presentation forms"]


# transliteration


@pytest.mark.parametrize("scheme,latin,arabic", [("buckwalter", "ktAb", "كتاب"), ("arabtex", "kitAb", "كِتاب"), ("iso233", "kitāb", "كِتاب"), ("arabtex", "^sams", "شَمس"), ("buckwalter", "1!", "1!"), ("iso-233", "kitāb", "كِتاب")])
def test_from_latin(spark, scheme, latin, arabic):
    assert translit.from_latin(latin, scheme) == arabic
    assert spark.createDataFrame([(latin,)], "t string").select(columns.from_latin_column(F.col("t"), scheme)).first()[0] == arabic


@pytest.mark.parametrize("scheme", translit.SCHEMES)
def test_to_latin_round_trip(spark, scheme):
    s = "كِتَاب قبل"
    latin, where = translit.to_latin(s, scheme)
    assert translit.from_latin(latin, scheme) == s and where == sorted(where)
    assert translit.map_boundaries(where, 0, len(s.encode())) == (0, len(latin.encode())) and translit.map_boundaries(where, 0, 999) is None
    assert spark.createDataFrame([(s,)], "t string").select(columns.to_latin_column(F.col("t"), scheme)).first()[0] == latin


# matchers


def texts_of(m, s):
    key = normalize(m.profile, s)
    return [key.encode()[a:b].decode() for a, b in m.find_all(key)]


def test_literals():
    assert Literal(("aa",), P).find_all("aaaa") == [(0, 2), (2, 4)]
    assert Literal(("beta", "alpha"), P).find_all("alpha beta") == [(0, 5), (6, 10)]
    assert Literal(("ab", "b"), P).find_all("ab") == [(0, 2), (1, 2)]
    m = Literal(("STRASSE",), P, True)
    assert m.matches("Straße") and m.find_all("Straße") == [(0, 7)]
    assert Literal(("s",), P, True).find_all("ß") == [(0, 2), (0, 2)]
    for bad in ((), ("",), ("َّ",)):
        with pytest.raises(ValueError):
            Literal(bad, P)
    with pytest.raises(EmptyKeyError):
        Fuzzy(("َ",), P)


def test_regex():
    assert texts_of(Regex(("مدرس[هة]",), P), "مَدْرَسَة") == ["مدرسه"]
    assert not Regex(("ة",), P).find_all(normalize(P, "مدرسة"))
    assert Regex((r"hello\s+world",), P, True).matches("Hello WORLD")
    assert Regex(("a*",), P).find_all("baaac") == [(0, 0), (1, 4), (5, 5)]
    assert Regex(("^",), P).find_all("abc") == [(0, 0)] and Regex(("$",), P).find_all("a\r") == [(2, 2)]
    assert Regex((r"\bx\b", "(?P<n>y+)"), P).find_all("x yy") == [(0, 1), (2, 4)]
    assert Regex((r"[[:alpha:]\d]+",), P).find_all("a1-é") == [(0, 2)]
    assert Regex((r"\p{Arabic}+",), P).find_all("a ب") == [(2, 4)]
    assert Regex((r"\Qa.b\E",), P).find_all("axb a.b") == [(4, 7)]
    assert Regex((r"a{2}",), P).find_all("aaa") == [(0, 2)] and Regex(("a{,2}",), P).find_all("a{,2}") == [(0, 5)]
    for bad in ("[", "(", ")", r"(a)\1", "(?=a)", "(?<!a)", "a++", "(?>a)", "*a", r"\Z", "a**", "[z-a]", "a{1001}"):
        with pytest.raises(ValueError):
            Regex((bad,), P)
    with pytest.raises(PatternError):
        translate_pattern("a\\")


def slow_fuzzy(q, s, k):
    prev = list(range(len(q) + 1))
    if s and prev[-1] <= k:
        return True
    for c in s:
        now = [0]
        for i, x in enumerate(q, 1):
            now.append(min(prev[i] + 1, now[-1] + 1, prev[i - 1] + (x != c)))
        prev = now
        if prev[-1] <= k:
            return True
    return False


@deep
@given(st.text("abc", min_size=1, max_size=6), st.text("abcd", max_size=14), st.integers(0, 3))
def test_fuzzy_by_dynamic_programming(q, s, k):
    m = Fuzzy((q,), P, False, k)
    assert m.matches(s) == slow_fuzzy(q, s, k) == bool(m.find_all(s))
    got = m.find_all(s)
    assert all(b1 <= a2 for (_, b1), (a2, _) in zip(got, got[1:]))


def test_fuzzy():
    for s in ("كتاب", "كتلب", "كتااب", "كتب"):
        assert texts_of(Fuzzy(("كتاب",), PROFILES["strict"]), f"هذا {s} جيد") == [s]
    assert Fuzzy(("abc",), P).find_all("abc abx") == [(0, 3), (4, 7)]
    t = "a" * 35 + "b" + "a" * 34
    assert Fuzzy(("a" * 70,), P).find_all(t) == [(0, 70)]
    assert Fuzzy(("STRASSE",), P, True, 0).find_all("Straße") == [(0, 7)]
    assert not Fuzzy(("ab",), P, False, 5).matches("") and Fuzzy(("ab",), P, False, 5).matches("z")
    with pytest.raises(ValueError):
        Fuzzy(("x",), P, False, -1)


@deep
@given(st.sampled_from(list(PROFILES.values()) + [resolve("search", "ar,fa"), resolve("strict", "fa")]), st.text(st.sampled_from(ALPHABET), min_size=1, max_size=5), texts, texts)
def test_proofs_on_raw_text_are_sound(p, q, a, b):
    try:
        m = Literal((q,), p)
    except EmptyKeyError:
        return
    s = a + q + b if len(a) % 2 else a + b
    hit = m.matches(normalize(p, s))
    if any(x in s for x in proofs(m)):
        assert hit
    if hit and (found := anchors(m)) is not None:
        forms = presentation_forms() if p.presentation else {}
        assert any(all(c in s or any(c in e and chr(f) in s for f, e in forms.items()) for c in letters[:2]) for letters in found)


def test_anchors_come_from_nowhere_else():
    for p in PROFILES.values():
        if p.rasm:
            continue
        for c in range(0x110000):
            if 0xD800 <= c < 0xE000 or (p.presentation and c in presentation_forms()) or chr(c) in ANCHORS:
                continue
            if c < 0x3000 or unicodedata.decomposition(chr(c)):
                assert not ANCHORS & set(normalize(p, chr(c)))


# selection over lines


def lines_df(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, line long, text string")


def without_kernel():
    one = lambda *o: resolve("search", "ar", o)
    return {"n9": PROFILES["strict"], "n17": one("keep_hamza"), "n19": one("keep_quranic_marks"), "n2": P}


@pytest.mark.parametrize("name", sorted(without_kernel()))
def test_common_arabic_keys_need_no_kernel(spark, name):
    p = without_kernel()[name]
    rows = ["اَلْعَرَبِيَّةُ", "آأإٱ مسؤول فئة ىٰ", "رُۖۥب\u200c\u200dن\u200f", "ﻻ يوجد ﻛﺘﺎﺏ" if p.presentation and name != "n19" else "لا", "café"]
    df = spark.createDataFrame([(x,) for x in rows], "text string")
    assert [r[0] for r in df.select(columns.key_column(F.col("text"), p, "native")).collect()] == [normalize(p, x) for x in rows]


def test_keys_are_exact_where_marks_stay_or_move(spark):
    rng = random.Random(7)
    letters = "اويىٱةكنرلآأؤإئۀۂۓۣۭ۪ۖۗۚۛۥٌِٰٕٓٔـﻻﻵﺁﺉﹰﹷ ẹ́́각"
    rows = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in rows], "text string")
    ps = [*without_kernel().values(), *PROFILES.values(), resolve("strict", "fa,ur", ("rasm", "keep_quranic_marks")), resolve("search", "ar,fa", ("keep_presentation_forms", "keep_quranic_marks"))]
    got = df.select("text", *(columns.key_column(F.col("text"), p).alias(f"k{i}") for i, p in enumerate(ps))).collect()
    for r in got:
        assert list(r[1:]) == [normalize(p, r.text) for p in ps], ascii(r.text)


def test_explain_tries_only_rules_that_can_matter(monkeypatch):
    from nasaq.functions import explain as module

    calls = []
    monkeypatch.setattr(module, "normalize", lambda p, s: calls.append(s) or normalize(p, s))
    assert explain("çà et là") == ("ca et la", ["Unicode NFD", "tashkil"]) and len(calls) <= 2
    rng = random.Random(8)
    for _ in range(2000):
        t = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 6)))
        name, langs = rng.choice(list(PROFILES)), rng.choice(("ar", "ar,fa", "fa", "ar,ur"))
        p = resolve(name, langs)
        rules = [n for n, f in module._NAMED if getattr(p, f) and normalize(replace(p, **{f: False}), t) != normalize(p, t)]
        if normalize(replace(p, languages=frozenset()), t) != normalize(p, t):
            rules.append("language equivalences")
        assert explain(t, name, langs) == (normalize(p, t), ["Unicode NFD"] * (unicodedata.normalize("NFD", t) != t) + rules)


def test_letters_are_swapped_where_there_are_any(spark):
    from nasaq.plans.queries import n28_key_reordered

    assert "[À-ÿ]" in n28_key_reordered(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_split_lines(spark):
    df = spark.createDataFrame([(1, "a\r\nb\n\nc\r"), (2, ""), (3, "x\n"), (4, None), (5, "p\rq\r\r\nz")], "doc_id long, text string")
    got = {}
    for r in split_lines(df).orderBy("doc_id", "line").collect():
        got.setdefault(r.doc_id, []).append((r.line, r.text))
    assert got == {1: [(1, "a"), (2, "b"), (3, ""), (4, "c\r")], 3: [(1, "x")], 5: [(1, "p\rq\r"), (2, "z")]}


def test_lines_carry_keys_only(spark):
    """Rows of lines that carry their whole text grow with its square, in Python's queues on disk too."""
    df = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plan = split_lines(df)._jdf.queryExecution().executedPlan().toString()
    carried = re.search(r"Generate posexplode\(.*\), \[([^\[\]]*)\], false, \[", plan, re.S).group(1)
    assert carried.split("#")[0] == "doc_id" and "," not in carried


def slow_context(hits, before, after):
    out, last = [], None
    for i, h in enumerate(hits, 1):
        near = any(hits[j - 1] for j in range(max(1, i - after), min(len(hits), i + before) + 1))
        if near:
            out.append((i, not h, last is not None and i > last + 1))
            last = i
    return out


def test_context_and_groups(spark):
    rng = random.Random(1)
    rows = [(d, i, rng.choice(["hit", "no", "no", "no"])) for d in range(12) for i in range(1, 25)]
    df = lines_df(spark, rows)
    for b, a in ((0, 0), (1, 0), (0, 2), (2, 3)):
        got = {}
        for r in S.search(df, Literal(("hit",), P), before=b, after=a).orderBy("doc_id", "line").collect():
            got.setdefault(r.doc_id, []).append((r.line, r.context, r.group_start))
        for d in range(12):
            want = slow_context([t == "hit" for x, _, t in rows if x == d], b, a)
            assert got.get(d, []) == (want if a or b else [(i, c, False) for i, c, _ in want])
    with pytest.raises(ValueError):
        S.search(df, Literal(("hit",), P), before=-1)


def test_select_count_and_names(spark):
    df = lines_df(spark, [(1, 1, "مَكْتَبَة"), (1, 2, "x"), (2, 1, "مكتبة مكتبة"), (3, 1, "y")])
    inputs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "doc_id long")
    m = Literal(("مكتبه",), P)
    assert sorted(map(tuple, S.count_selected(df, m, inputs).collect())) == [(1, 1), (2, 1), (3, 0), (4, 0)]
    assert sorted(r[0] for r in S.inputs_with(df, m, inputs).collect()) == [1, 2]
    assert sorted(r[0] for r in S.inputs_with(df, m, inputs, without=True).collect()) == [3, 4]
    assert sorted(map(tuple, S.first_selected(df, m, invert=True).collect())) == [(1, 2), (3, 1)]
    for kind in ("literal", "regex", "fuzzy"):
        mk = build(["مكتبه"], P, kind=kind)
        for word in (False, True):
            for spans in (False, True):
                r = S.select_lines(df, mk, word=word, spans=spans).where("selected").count()
                assert r == 2, (kind, word, spans)


def test_word_and_inverted_spans(spark):
    assert search_text(Literal(("می",), resolve("search", "fa")), "می‌روم", True) is None
    assert search_text(Literal(("می",), resolve("search", "ar")), "می روم", True) == [(0, 4)]
    assert search_text(Literal(("a",), P), "ba a_ a", True) == [(6, 7)]
    df = lines_df(spark, [(1, 1, "ab"), (1, 2, "a b"), (1, 3, "zz")])
    rows = S.search(df, Literal(("a",), P), invert=True, word=True, spans=True, after=1).orderBy("line").collect()
    assert [(r.line, r.context) for r in rows] == [(1, False), (2, True), (3, False)]
    assert [tuple(s) for s in rows[1].spans] == [(0, 1)] and rows[0].spans is None


def test_prefilter_changes_nothing_and_reaches_the_scan(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, 1, "".join(rng.choice(ALPHABET) for _ in range(12))) for i in range(600)]
    lines_df(spark, rows).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for q in ("لا", "ب", "كت", "ة"):
        m = Literal((q,), P)
        want = sorted(i for i, _, t in rows if m.matches(normalize(P, t)))
        assert sorted(r.doc_id for r in S.search(df, m).collect()) == want == sorted(r.doc_id for r in S.select_lines(df, m, prefilter=False).where("selected").collect())
    whole = spark.createDataFrame([(i, "\n".join(t for _, _, t in rows[i * 3 : i * 3 + 3])) for i in range(200)], "doc_id long, text string")
    for q in ("لا", "ب", "كت"):
        m = Literal((q,), P)
        kept = S.candidates(whole, m)
        assert S.search(split_lines(kept), m).exceptAll(S.search(split_lines(whole), m)).count() == 0 and S.search(split_lines(kept), m).count() == S.search(split_lines(whole), m).count()
        assert q == "لا" or kept.count() < 200
    strict = Literal(("ب",), PROFILES["lucene"])
    plan = df.where(must_match(F.col("text"), strict))._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(text,ب)" in plan


# the command


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


CASES = [
    ("قَالَ ٱللَّهُۖ غَفُورٌ", ["الله"], [[[11, 27]]]), ("يـا لَيْلُ، طَالَ", ["يا ليل"], [[[0, 19]]]), ("ﻻ يوجد ﻛﺘﺎﺏ", ["لا يوجد كتاب"], [[[0, 25]]]), ("ﻻ يوجد", ["لا"], [[[0, 3]]]),
    ("كتااب\nكتاب", ["--fuzzy=1", "كتاب"], [[[0, 10]], [[0, 8]]]), ("كتاب", ["--rasm", "كثاب"], [[[0, 8]]]), ("wow 😄 كتاب ۱۲۳!", ["--fold-digits", "123"], [[[18, 24]]]),
    ("کتاب تازه", ["--lang=ar,fa", "كتاب"], [[[0, 8]]]), ("می‌روم", ["--lang=fa", "-w", "می"], []), ("می‌روم", ["--lang=fa", "می‌روم"], [[[0, 13]]]), ("بَتَاب", ["بتاب"], [[[0, 12]]]),
    ("Straße", ["-i", "STRASSE"], [[[0, 7]]]), ("ab\ncd", ["--regex", "^"], [[[0, 0]], [[0, 0]]]), ("كتاب", ["--translit=buckwalter", "ktAb"], [[[0, 8]]]), ("كتاب", ["--translit-out", "كتاب"], [[[0, 4]]]),
    ("ٹ", ["--profile=strict", "--lang=ur", "ت"], []), ("ۍ", ["--profile=strict", "--lang=ps", "ي"], []), ("x" * 5000 + " كتاب", ["كتاب"], [[[5001, 5009]]]),
]


@pytest.mark.parametrize("text,args,spans", CASES)
def test_golden_cases(spark, tmp_path, text, args, spans):
    path = write(tmp_path / "f.txt", text + "\n")
    r = run(spark, ["--json", *args, path])
    found = [json.loads(x) for x in r.stdout.splitlines()]
    assert (r.status, r.stderr) == (0 if spans else 1, "") and [f["spans"] for f in found] == spans
    assert all(f["file"] == path and list(f)[:3] == ["file", "line", "text"] for f in found)


@pytest.mark.parametrize("codec,name,text,q,span", [("cp1256", "cp1256", "هذه مدينة", "مدينه", [7, 17]), ("iso8859-6", "iso-8859-6", "كتاب", "كتاب", [0, 8]), ("utf-16-le", "utf16le", "هذه مدينة", "مدينه", [7, 17]), ("utf-16-be", "utf16be", "هذه مدينة", "مدينه", [7, 17]), ("cp1256", "auto", "هذه مدينة", "مدينه", [7, 17]), ("utf-16", "auto", "هذه مدينة", "مدينه", [7, 17]), ("utf-8-sig", "auto", "كتاب", "كتاب", [0, 8])])
def test_encodings(spark, tmp_path, codec, name, text, q, span):
    path = write(tmp_path / "f.bin", (text + "\n").encode(codec))
    r = run(spark, ["--json", f"--encoding={name}", q, path])
    assert json.loads(r.stdout) == {"file": path, "line": 1, "text": text, "spans": [span]}


def test_output_and_status(spark, tmp_path):
    a, b = write(tmp_path / "a.txt", "one hit\ntwo\nthree\nfour hit hit\n"), write(tmp_path / "b.txt", "none\n")
    go = lambda *x, stdin=b"": run(spark, list(x), stdin)
    assert go("--json", "مدينه", stdin="x\nالمَدِينَة <tag>\n".encode()).stdout == '{"line":2,"text":"المَدِينَة <tag>","spans":[[4,20]]}\n'
    assert go("-n", "hit", a).stdout == "1:one hit\n4:four hit hit\n"
    assert go("-n", "hit", b, a).stdout == f"{a}:1:one hit\n{a}:4:four hit hit\n"
    assert go("-h", "-A", "1", "-n", "hit", a, b).stdout == "1:one hit\n2-two\n--\n4:four hit hit\n"
    assert go("-H", "-C", "1", "hit", a).stdout == f"{a}:one hit\n{a}-two\n{a}-three\n{a}:four hit hit\n"
    assert go("-o", "-n", "hit", a).stdout == "1:hit\n4:hit\n4:hit\n"
    assert go("-c", "hit", a, b).stdout == f"{a}:2\n{b}:0\n" and go("-c", "hit", a).stdout == "2\n"
    assert go("-l", "hit", a, b).stdout == f"{a}\n" and go("-L", "hit", a, b).stdout == f"{b}\n" and go("-L", "hit", a).status == 1
    assert go("-v", "hit", a).stdout == "two\nthree\n"
    assert go("--color=always", "hit", a).stdout == "one \x1b[01;31mhit\x1b[m\nfour \x1b[01;31mhit\x1b[m \x1b[01;31mhit\x1b[m\n"
    assert go("--", "-x", stdin=b"a -x\n").stdout == "a -x\n" and go("x", stdin=b"y\n").status == 1
    assert go("-e", "two", "-e", "one", a).stdout == "one hit\ntwo\n"
    for bad in ([], [""], ["َ"], ["-c", "-l", "x"], ["--json", "-c", "x"], ["-o", "-v", "x"], ["--regex", "--fuzzy", "x"], ["--regex", "--translit=iso233", "x"], ["--fuzzy=-1", "x"], ["--threads", "0", "x"], ["--lang=zz", "x"], ["--nope", "x"], ["--encoding=zz", "x"], ["--profile=zz", "x"], ["-A", "-1", "x"]):
        assert run(spark, bad).status == 2, bad
    with pytest.raises(UsageError):
        parse(["--color=maybe", "x"])


def test_errors_keep_other_files(spark, tmp_path):
    bad, ok = write(tmp_path / "bad.txt", b"hit\n\xff\nhit\n"), write(tmp_path / "ok.txt", "hit\n")
    r = run(spark, ["-h", "hit", bad, ok, str(tmp_path / "gone")])
    assert r.status == 2 and r.stdout == "hit\nhit\n" and "not valid UTF-8 on line 2; try --encoding=auto" in r.stderr and "gone" in r.stderr
    assert run(spark, ["-c", "hit", bad, ok]).stdout == f"{ok}:1\n"
    assert run(spark, ["--max-line-bytes", "4", "1", write(tmp_path / "l.txt", "12345\n")]).status == 2
    assert run(spark, ["--max-line-bytes", "4", "1", write(tmp_path / "m.txt", "1234\r\n")]).stdout == "1234\n"
    assert run(spark, ["x", str(tmp_path)]).status == 2
    rows = search_files(spark, [bad, ok], "hit").collect()
    assert sum(r.error is None for r in rows) == 2 and sum(r.error is not None for r in rows) == 1


def test_discovery(spark, tmp_path):
    for name, text in ((".gitignore", "ignored.txt\ncache/\n*.log\n!keep.log\n"), ("a.txt", "a"), ("ignored.txt", "a"), ("keep.log", "a"), ("drop.log", "a"), ("skip.md", "a"), ("cache/d.txt", "a"), ("n/.gitignore", "local.txt\n"), ("n/b.txt", "a"), ("n/local.txt", "a"), (".git/x.txt", "a"), (".hidden.txt", "a")):
        write(tmp_path / name, text)
    root = str(tmp_path)
    files = lambda *a, **k: [f.removeprefix(root + "/") for f in discover.collect(list(a), **k)[0]]
    assert files(root, recursive=True, includes=["*.txt", "*.log"]) == [".hidden.txt", "a.txt", "keep.log", "n/b.txt"]
    assert files(root, recursive=True, no_ignore=True, excludes=["*.txt"]) == [".gitignore", "drop.log", "keep.log", "n/.gitignore", "skip.md"]
    assert files(f"{root}/n/b.txt", f"{root}/a.txt", f"{root}/n/b.txt") == ["n/b.txt", "a.txt"]
    assert discover.collect([root])[1] == [f"{root}: is a directory (use --recursive)"]
    assert discover.discover(["-", "-"])[0] == [(None, discover.STDIN)]
    write(tmp_path / "r/.gitignore", "/top.txt\n\\!bang.txt\n# c\n")
    for f in ("top.txt", "s/top.txt", "!bang.txt"):
        write(tmp_path / "r" / f, "a")
    assert [f.removeprefix(f"{root}/r/") for f in discover.collect([f"{root}/r"], True, includes=["*.txt"])[0]] == ["s/top.txt"]
    for g, name, ok in (("*.txt", "a/b.txt", False), ("**/*.txt", "a/b.txt", True), ("a/**", "a/b/c", True), ("[!a]b", "cb", True), ("[!a]b", "ab", False), ("a?c", "a/c", False)):
        assert bool(discover.compile_glob(g).search(name)) == ok
    for g in ("", "[a"):
        with pytest.raises(ValueError):
            discover.compile_glob(g)
    assert run(spark, ["-r", "-l", "a", "--", root]).status == 2  # options end at the first operand
    assert run(spark, ["-r", "-c", "a", root]).stdout.count(":1\n") >= 4


def test_detection():
    assert decode.detect("هذه مدينة".encode("cp1256")) == "cp1256" and decode.detect(b"plain") == "utf8" and decode.detect(b"") == "utf8"
    assert decode.detect("كتاب قديم".encode("utf-16-le")) == "utf16le" and decode.detect("كتاب قديم".encode("utf-16-be")) == "utf16be"
    assert decode.to_utf8(b"\xef\xbb\xbfx", "utf8")[0] == b"\xef\xbb\xbfx" and decode.to_utf8(b"\xef\xbb\xbfx", "auto")[0] == b"x"
    long = ("x" * (decode.SAMPLE - 1)).encode() + "ب".encode() + b"\xff"
    assert decode.to_utf8(long, "auto") == (long[:-1] + "�".encode(), "utf8")
    assert decode.decode_as(b"\xff\xfex\0", "utf16be") == "x" and decode.parse_encoding("Windows-1256".lower()) == "cp1256"


def test_html_and_epub(spark, tmp_path):
    page = "<html><head><title>T</title><style>no</style></head><body><h1>عنوان</h1><p>هذه <b>مدينة</b>جميلة<br>x</p><script>no</script>&amp; tail</body></html>"
    assert formats.html_text(page) == "T\nعنوان\nهذه مدينة جميلة\nx\n& tail\n" and formats.html_text("") == ""
    for raw, text in (("a<5 b &am c&amp", "a<5 b &am c&\n"), ("<p>x</p", "x\n"), ("x<b", "x\n"), ("x<!-- y", "x\n"), ("a<!-- - -->b", "a b\n"), ("a < b", "a < b\n"), ("<script>x", "")):
        assert formats.html_text(raw) == text
    legacy = '<meta charset="windows-1256"><p>مدينة</p>'.encode("cp1256")
    assert formats.html_bytes_text(legacy) == "مدينة\n"
    book = tmp_path / "b.epub"
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", '<package><manifest><item id="b" href="b.x#f" media-type="application/xhtml+xml"/><item id="a" href="a.x" media-type="text/html"/><item id="c" href="c.css" media-type="text/css"/></manifest><spine><itemref idref="a"/><itemref idref="c"/><itemref idref="b"/></spine></package>')
        z.writestr("O/a.x", "<p>الفصل الأول</p>")
        z.writestr("O/b.x", "<p>الفصل الثاني</p>")
    assert formats.epub_text(book.read_bytes()) == "الفصل الأول\nالفصل الثاني\n"
    html = write(tmp_path / "p.HTML", page)
    assert run(spark, ["-h", "-n", "الفصل", str(book), html]).stdout == "1:الفصل الأول\n2:الفصل الثاني\n"
    assert run(spark, ["--encoding=cp1256", "x", html]).status == 2
    assert spark.createDataFrame([(page,)], "h string").select(formats.html_text_column(F.col("h"))).first()[0].startswith("T\n")


def test_store_reader_and_highlight(spark, tmp_path):
    write(tmp_path / "d/a.txt", "x\nكتاب\n")
    rows = read_store(spark, [str(tmp_path / "d")]).collect()
    assert [(r.line, r.text) for r in rows] == [(1, "x"), (2, "كتاب")]
    assert mark("abcd", [(0, 2), (1, 3)], "<mark>", "</mark>") == "<mark>abc</mark>d"
    assert mark("كتاب", [(0, 8)]) == "⁧\x1b[01;31mكتاب\x1b[m⁩" and mark("كتاب", [(0, 8)], isolate=False).startswith("\x1b")
    df = spark.createDataFrame([("abc", [(1, 2)])], "t string, s array<struct<start:int,end:int>>")
    assert df.select(highlight_column(F.col("t"), F.col("s"), "<", ">")).first()[0] == "a<b>c"


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    write(src / "1.txt", "a\nhit one\r\nb\rhit\nc\n")
    q = stream.search_stream(stream.read_lines(spark, str(src)), Literal(("hit",), P), spans=True).select("text", "spans").writeStream.format("memory").queryName("hits").outputMode("append").start()
    q.processAllAvailable()
    write(src / "2.txt", "late hit\n")
    q.processAllAvailable()
    q.stop()
    assert sorted(r.text for r in spark.table("hits").collect()) == ["b\rhit", "hit one", "late hit"]
    rows = [("f", i, t) for i, t in enumerate(["a", "b", "hit", "c", "d", "e", "hit", "z"], 1)]
    tab = tmp_path / "tab"
    spark.createDataFrame(rows[:4], "file string, line long, text string").coalesce(1).write.parquet(str(tab))
    s = spark.readStream.schema("file string, line long, text string").parquet(str(tab))
    q = stream.search_stream_context(s, Literal(("hit",), P), before=1, after=1).writeStream.format("memory").queryName("ctx").outputMode("append").start()
    q.processAllAvailable()
    spark.createDataFrame(rows[4:], "file string, line long, text string").coalesce(1).write.mode("append").parquet(str(tab))
    q.processAllAvailable()
    q.stop()
    got = sorted((r.line, r.context, r.group_start) for r in spark.table("ctx").collect())
    assert got == [(2, True, False), (3, False, False), (4, True, False), (6, True, True), (7, False, False), (8, True, False)]
