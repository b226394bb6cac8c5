"""Registered queries of the search engine over the driver's tables, each over whole tables."""

from __future__ import annotations

import unicodedata
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.profile import PROFILES, Profile, resolve
from ..operators import search as S
from ..operators.matchers import Fuzzy, Literal, Matcher, Regex
from ..operators.spans import highlight_column, only_matching_column, transliterate_match
from ..shipping import ship
from ..sources.decode import decode_column
from ..sources.formats import html_text_column
from ..sources.lines import split_lines
from ..streaming.search import search_stream
from .render import human_lines, json_lines

P = PROFILES["search"]
DOC = ["doc_id", "line"]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _lines(spark: SparkSession, sf_dir: str, m: Matcher | None = None) -> DataFrame:
    """The documents' lines; only of texts that can match, if ``m`` is given."""
    d = _docs(spark, sf_dir)
    return split_lines(d if m is None else S.candidates(d, m))


def _arabic_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in Arabic letters, by Buckwalter's letters."""
    return _docs(spark, sf_dir).select("doc_id", C.from_latin_column(F.col("text")).alias("text"))


def _arabic(spark: SparkSession, sf_dir: str, m: Matcher | None = None) -> DataFrame:
    """Their lines; only of texts that can match, if ``m`` is given."""
    d = _arabic_docs(spark, sf_dir)
    return split_lines(d if m is None else S.candidates(d, m))


def _literal(*q: str, profile: Profile = P, ignore_case: bool = False) -> Literal:
    return Literal(q, profile, ignore_case)


def _span_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))))


# sources


def s18_lines(spark, sf_dir):
    return _lines(spark, sf_dir)


def w3_line_counts(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("doc_id").agg(F.max("line").alias("n_lines"))


def s10_decode_utf16(spark, sf_dir):
    d = _docs(spark, sf_dir).where("text IS NOT NULL")
    raw = d.select("doc_id", F.encode("text", "UTF-16LE").alias("content"))
    return raw.select("doc_id", decode_column(F.col("content"), "utf16le").alias("d")).select("doc_id", F.col("d.text").alias("text"), F.col("d.encoding").alias("encoding"))


def s11_detect_encoding(spark, sf_dir):
    d = _docs(spark, sf_dir).where("text IS NOT NULL")
    raw = d.select("doc_id", F.explode(F.array(F.encode("text", "UTF-16"), F.encode("text", "UTF-8"))).alias("content"))
    return raw.select("doc_id", decode_column(F.col("content"), "auto").alias("d")).select("doc_id", F.col("d.encoding").alias("encoding"), F.md5("d.text").alias("text_md5"))


def s14_html_text(spark, sf_dir):
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", html_text_column(F.col("html")).alias("text"))


def s19_line_limit(spark, sf_dir):
    return S.first_faults(_lines(spark, sf_dir), ["doc_id"], 400)


def s20_invalid_utf8(spark, sf_dir):
    """Lines with a byte that is no UTF-8: every fifth one, and those with a word part."""
    bad = (F.col("line") % 5 == 0) | F.contains("text", F.lit("tion"))
    raw = F.when(bad, F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF")))).otherwise(F.col("text").cast("binary"))
    return S.first_faults(_lines(spark, sf_dir).withColumn("text", raw.cast("string")), ["doc_id"])


def a6_lines_before_fault(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return S.until_fault(lines, S.first_faults(lines, ["doc_id"], 400), ["doc_id"]).select("doc_id", "line", "text")


# comparison keys


def _key(lines: DataFrame, **profiles: Profile) -> DataFrame:
    return lines.select(*DOC, *(C.key_column(F.col("text"), p).alias(n) for n, p in profiles.items()))


def n1_key_latin(spark, sf_dir):
    return _key(_lines(spark, sf_dir), key=P)


def n5_key_latin_decomposed(spark, sf_dir):
    return _key(_lines(spark, sf_dir), key=PROFILES["lucene"])


def n28_key_reordered(spark, sf_dir):
    """Decomposed letters whose marks are out of canonical order: a key of code points puts them in order, one without marks drops them."""
    text = F.col("text")
    for first, last in ((0xC0, 0xFF), (0x100, 0x17F)):  # a block's letters are looked for one by one only where it has any
        swapped = text
        for c in range(first, last + 1):
            d = unicodedata.normalize("NFD", chr(c))
            if len(d) == 2:
                swapped = F.replace(swapped, F.lit(chr(c)), F.lit(d + "\u0323"))
        text = F.when(C.is_ascii(F.col("text")) | ~F.col("text").rlike(f"[{chr(first)}-{chr(last)}]"), text).otherwise(swapped)
    t = _lines(spark, sf_dir).withColumn("text", text)
    return t.select(*DOC, F.col("text").alias("given"), C.key_column(F.col("text"), PROFILES["lucene"]).alias("key"), C.key_column(F.col("text"), P).alias("key_search"))


def n7_key_search(spark, sf_dir):
    return _key(_arabic(spark, sf_dir), key=P)


def n9_key_strict(spark, sf_dir):
    return _key(_arabic(spark, sf_dir), key=PROFILES["strict"])


def n25_key_loose(spark, sf_dir):
    return _key(_arabic(spark, sf_dir), key=PROFILES["loose"])


def n11_key_lucene(spark, sf_dir):
    return _key(_arabic(spark, sf_dir), key=PROFILES["lucene"])


def n11_key_camel(spark, sf_dir):
    return _key(_arabic(spark, sf_dir), key=PROFILES["camel"])


def n13_key_languages(spark, sf_dir):
    t = _arabic(spark, sf_dir).withColumn("text", F.translate("text", "كيةه", "کیۀہ"))
    return _key(t, key_ar=P, key_ar_fa=resolve("search", "ar,fa"), key_ar_ur=resolve("search", "ar,ur"), key_fa=resolve("search", "fa"))


def n19_key_controls(spark, sf_dir):
    t = _arabic(spark, sf_dir).withColumn("text", F.replace(F.replace(F.replace("text", F.lit("ب"), F.lit("ب‌‍")), F.lit("ن"), F.lit("ن‏⁦")), F.lit("ر"), F.lit("رۖۥ")))
    one = lambda o: resolve("search", "ar", (o,))
    return _key(t, key=P, key_joiners=one("keep_joiners"), key_bidi=one("keep_bidi_marks"), key_quranic=one("keep_quranic_marks"), key_fa=resolve("search", "fa"))


def n2_key_presentation(spark, sf_dir):
    t = _arabic(spark, sf_dir).withColumn("text", F.replace(F.translate("text", "كم", "ﻛﻤ"), F.lit("لا"), F.lit("ﻻ")))
    return _key(t, key=P, key_forms=resolve("search", "ar", ("keep_presentation_forms",)))


def n17_key_overrides(spark, sf_dir):
    one = lambda *o: resolve("search", "ar", o)
    return _key(_arabic(spark, sf_dir), key_hamza=one("keep_hamza"), key_tamarbuta=one("keep_tamarbuta"), key_rasm=one("rasm"))


def n23_digits(spark, sf_dir):
    t = _lines(spark, sf_dir).withColumn("text", F.translate("text", "0123456789,;?%.", "٠١٢٣٤٥٦٧٨٩،؛؟٪۔"))
    p = resolve("search", "ar", ("fold_digits", "fold_punctuation"))
    return t.select(*DOC, C.digits_column(F.col("text")).alias("digits"), C.punctuation_column(F.col("text")).alias("punctuation"), C.key_column(F.col("text"), p).alias("key"))


def n25_rasm(spark, sf_dir):
    return _arabic(spark, sf_dir).select(*DOC, C.rasm_column(F.col("text")).alias("skeleton"))


def n26_key_index(spark, sf_dir):
    m = _lines(spark, sf_dir).select(*DOC, C.mapped_key_column(F.col("text"), P).alias("m"))
    return m.select(*DOC, F.col("m.key").alias("key"), F.md5(F.array_join(F.col("m.index").cast("array<string>"), ",")).alias("index_md5"))


def n33_explain(spark, sf_dir):
    e = _lines(spark, sf_dir).select(*DOC, C.explain_column(F.col("text")).alias("e"))
    return e.select(*DOC, F.col("e.key").alias("key"), F.array_join("e.rules", ",").alias("rules"))


# transliteration


def t1_from_buckwalter(spark, sf_dir):
    return _arabic(spark, sf_dir)


def t1_from_arabtex(spark, sf_dir):
    return _lines(spark, sf_dir).withColumn("text", C.from_latin_column(F.col("text"), "arabtex"))


def t1_from_iso233(spark, sf_dir):
    return _lines(spark, sf_dir).withColumn("text", C.from_latin_column(F.col("text"), "iso233"))


def t2_to_buckwalter(spark, sf_dir):
    return _arabic(spark, sf_dir).withColumn("text", C.to_latin_column(F.col("text")))


def t2_to_arabtex(spark, sf_dir):
    return _arabic(spark, sf_dir).withColumn("text", C.to_latin_column(F.col("text"), "arabtex"))


def t2_to_iso233(spark, sf_dir):
    return _arabic(spark, sf_dir).withColumn("text", C.to_latin_column(F.col("text"), "iso233"))


def t7_translit_matches(spark, sf_dir):
    """Matches in Arabic letters, shown in Latin ones with their spans moved along."""
    m = _literal("نت")
    s = S.search(_arabic(spark, sf_dir, m), m, spans=True).withColumn("t", transliterate_match(F.col("text"), F.col("spans")))
    return s.select(*DOC, F.col("t.text").alias("text"), _span_text(F.col("t.spans")).alias("spans"))


# matching


def _found(lines: DataFrame, m, **options) -> DataFrame:
    return S.search(lines, m, **options).select(*DOC, "text")


def _found_spans(lines: DataFrame, m, **options) -> DataFrame:
    s = S.search(lines, m, spans=True, **options)
    return s.select(*DOC, "text", _span_text(F.col("spans")).alias("spans"))


def m1_literal(spark, sf_dir):
    m = _literal("Tión")
    return _found(_lines(spark, sf_dir, m), m)


def m1_any_of(spark, sf_dir):
    m = _literal("ationt", "scherr", "èparre", "ciónta")
    return _found(_lines(spark, sf_dir, m), m)


def m1_arabic_prefiltered(spark, sf_dir):
    m = _literal("خَطْقْ", "نَتْن")
    return _found(_arabic(spark, sf_dir, m), m)


def m1_conversations(spark, sf_dir):
    ship(spark)
    m = _literal("theth")
    lines = split_lines(S.candidates(spark.read.parquet(f"{sf_dir}/conversations.parquet"), m), keys=["conv_id", "turn", "role"])
    return S.search(lines, m, keys=["conv_id", "turn", "role"]).select("conv_id", "turn", "role", "line", "text")


def m3_literal_spans(spark, sf_dir):
    m = _literal("tion")
    return _found_spans(_lines(spark, sf_dir, m), m)


def m3_any_of_spans(spark, sf_dir):
    m = _literal("نت")
    return _found_spans(_arabic(spark, sf_dir, m), m)


def m4_ignore_case(spark, sf_dir):
    return _found(_lines(spark, sf_dir), _literal("STRASS", "ERIER", ignore_case=True))


def m5_regex(spark, sf_dir):
    return _found(_lines(spark, sf_dir), Regex((r"\bth\w+ (?:and|of)\b", r"^[A-E][a-z]{2,4}\.$", r"[[:digit:]]{4}"), P))


def m6_regex_spans(spark, sf_dir):
    return _found_spans(_lines(spark, sf_dir), Regex((r"th[a-z]*e",), P))


def m7_fuzzy(spark, sf_dir):
    m = Fuzzy(("therand",), P, False, 1)
    return _found(_lines(spark, sf_dir, m), m)


def m10_fuzzy_spans(spark, sf_dir):
    m = Fuzzy(("therand",), P, False, 1)
    return _found_spans(_lines(spark, sf_dir, m), m)


def m13_invert(spark, sf_dir):
    return _found(_lines(spark, sf_dir), _literal("e"), invert=True)


def m14_word(spark, sf_dir):
    m = _literal("des")
    return _found(_lines(spark, sf_dir, m), m, word=True)


def m14_word_spans(spark, sf_dir):
    m = _literal("des")
    return _found_spans(_lines(spark, sf_dir, m), m, word=True)


def j1_patterns_in_texts(spark, sf_dir):
    """Benchmark items whose key lies in a document's key."""
    key = lambda df: df.where("text IS NOT NULL").withColumn("key", C.key_column(F.col("text"), P))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return S.pattern_join(key(items).select("item_id", "key"), key(_docs(spark, sf_dir)).select("doc_id", "key"), pattern_key="item_id", text_key="doc_id")


# context


def w1_context(spark, sf_dir):
    m = _literal("theth")
    return S.search(_lines(spark, sf_dir, m), m, before=1, after=2).select(*DOC, "text", "context", "group_start")


def w1_context_inverted(spark, sf_dir):
    return S.search(_lines(spark, sf_dir), _literal("e"), invert=True, before=2, after=0).select(*DOC, "text", "context", "group_start")


# summaries


def a1_count_per_document(spark, sf_dir):
    return S.count_in_texts(_docs(spark, sf_dir), _literal("tion")).select("doc_id", "selected")


def a1_count_arabic(spark, sf_dir):
    return S.count_in_texts(_arabic_docs(spark, sf_dir), _literal("نت")).select("doc_id", "selected")


def a2_documents_with(spark, sf_dir):
    return S.texts_with(_docs(spark, sf_dir), _literal("theth")).select("doc_id")


def a3_documents_without(spark, sf_dir):
    return S.texts_with(_docs(spark, sf_dir), _literal("theth"), without=True).select("doc_id")


def a4_first_line(spark, sf_dir):
    return S.first_in_texts(_docs(spark, sf_dir), _literal("tion")).select("doc_id", "line")


def a5_status(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return S.status(S.select_lines(lines, _literal("tion")), S.first_faults(lines, ["doc_id"]))


# output


def p1_json_lines(spark, sf_dir):
    m = _literal("ation")
    s = S.search(_lines(spark, sf_dir, m), m, spans=True, before=1)
    return json_lines(s.withColumn("file", F.col("doc_id").cast("string"))).select(*DOC, "out")


def p2_human_lines(spark, sf_dir):
    m = _literal("theth")
    s = S.search(_lines(spark, sf_dir, m), m, before=1, after=1)
    return human_lines(s.withColumn("file", F.col("doc_id").cast("string")), line_numbers=True, filenames=True).select(*DOC, "out")


def p3_only_matching(spark, sf_dir):
    s = S.search(_lines(spark, sf_dir), Regex((r"th[a-z]*e",), P), spans=True)
    return s.select(*DOC, F.posexplode(only_matching_column(F.col("text"), F.col("spans"))).alias("pos", "part"))


def p4_highlight(spark, sf_dir):
    m = _literal("tion")
    s = S.search(_lines(spark, sf_dir, m), m, spans=True)
    return s.select(*DOC, highlight_column(F.col("text"), F.col("spans"), "<mark>", "</mark>").alias("out"))


# streams


def r1_stream(spark, sf_dir):
    """A stream over the documents as they arrive; what is there now is searched and the results reread."""
    where = _shared(spark)
    schema = _docs(spark, sf_dir).schema
    # as a glob, which may be one file or a folder of them
    lines = split_lines(spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]"))
    found = search_stream(lines, _literal("Tión")).select(*DOC, "text")
    q = found.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{where}/out")


def _shared(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:  # one machine, as in tests
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="nasaq-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/nasaq/stream-{uuid.uuid4().hex}"


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and f.__name__[0] != "_"}
