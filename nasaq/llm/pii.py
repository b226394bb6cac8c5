"""Sanitising personal data by what the corpus discloses, in Spark expressions only.

Protected entities are e-mail and IP addresses, card and phone numbers.  A term
discloses an entity as far as the documents say that have both, wherever they
stand: the pointwise mutual information of term and entity, as a share of the
entity's information content.  A term over the threshold is removed wherever it
occurs.

Java matches a repeated group recursively; every pattern here repeats only
character classes, or groups possessively or within bounds, so that no text
overflows the stack, and none is tried anew at each character of a run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import pick, stage, unclash

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = r"[A-Za-z0-9._%+-]"
#: Begins where a run of its characters begins, or where the last match ended.
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A whole chain of digits with single separators that has 13 to 19 digits; others would be dropped anyway.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Letters that a term has at least.
TERM_LETTERS = 4
#: Share of the entity's information content that a term may disclose.
DISCLOSURE = 0.9

#: Bytes of terms or spans that are broadcast to the texts; more are joined by a shuffle.
FEW_BYTES = 16 << 20

_SPAN = "struct<kind:int,s:int,e:int,v:string>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _running(items: Column, move: Callable[[Column, Column], Column], make: Callable[[Column, Column, Column], Column], kind: str, held: Callable[[Column, Column], Column] = lambda at, end: F.lit(None).cast("string")) -> Column:
    """array of make(at, item, held) where ``at``, from 0, runs on by move(at, item).

    Arrays are immutable, so appending n items one by one copies n^2 of them;
    items are taken in about sqrt(n) blocks of sqrt(n), which copies n^1.5.
    ``held`` is made once a block, of the block's ``at`` before and after.
    """
    none = F.array().cast(f"array<{kind}>")
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items))).cast("int"))

    def of(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x["i"]) - 1) / x["n"]).cast("int")), lambda k: F.slice(x["i"], k * x["n"] + 1, x["n"]))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        heads = lambda every: F.aggregate(every, first, lambda acc, one: F.struct(F.aggregate(one, acc["at"], move).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]

        def block(one: Column, at: Column) -> Column:
            def walk(kept: Column) -> Column:
                start = F.struct(at.alias("at"), none.alias("out"))
                step = lambda acc, y: F.struct(move(acc["at"], y).alias("at"), F.array_append(acc["out"], make(acc["at"], y, kept["v"])).alias("out"))
                return F.aggregate(one, start, step)["out"]

            return _let(F.struct(held(at, F.aggregate(one, at, move)).alias("v")), walk)

        return _let(blocks, lambda every: F.flatten(F.zip_with(every, heads(every), block)))

    return F.when(F.size(items) > 0, _let(F.struct(items.alias("i"), size.alias("n")), of)).otherwise(none)


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """Spans of a pattern's matches; between matches, ``split`` gives what lies before each."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    zipped = _let(both, lambda z: F.arrays_zip(F.slice(z["g"], 1, F.size(z["m"])).alias("g"), z["m"].alias("m")))
    start = lambda at, x: at + F.char_length(x["g"])
    end = lambda at, x: start(at, x) + F.char_length(x["m"])
    span = lambda at, x, _: F.struct(F.lit(kind).alias("kind"), start(at, x).alias("s"), end(at, x).alias("e"), x["m"].alias("v"))
    return _let(zipped, lambda items: _running(items, end, span, _SPAN))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = F.reverse(_digits(v))

    def step(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return acc + x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds, in order of kind and start; offsets in code points, end exclusive."""
    none = F.array().cast(f"array<{_SPAN}>")
    email = F.when(F.contains(text, F.lit("@")), _matches(text, EMAIL, 0)).otherwise(none)
    ip = F.when(text.rlike(r"[0-9]\.[0-9]"), _matches(text, IP, 1)).otherwise(none)
    part_ok = lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$")
    ip = F.filter(ip, lambda x: F.forall(F.split(x["v"], r"\."), part_ok))
    card = F.when(text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), _matches(text, CARD, 2)).otherwise(none)
    card = F.filter(card, lambda x: _luhn(x["v"]))
    phone = F.when(F.contains(text, F.lit("+")), _matches(text, PHONE, 3)).otherwise(none)
    phone = F.filter(phone, lambda x: F.length(_digits(x["v"])).between(9, 15))
    return F.concat(email, ip, card, phone)


def _entity(x: Column) -> Column:
    plain = F.when(x["kind"] == 0, F.lower(x["v"])).when(x["kind"] == 1, x["v"]).otherwise(_digits(x["v"]))
    return F.concat(x["kind"].cast("string"), F.lit(":"), plain)


def _words(text: Column) -> Column:
    """Distinct lower-cased words that may be terms."""
    long = F.filter(F.array_distinct(F.split(text, r"[^\p{L}]+")), lambda w: F.char_length(w) >= TERM_LETTERS)
    return F.array_distinct(F.transform(long, F.lower))


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text): h is the text's hash; null texts are empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return pick(docs, "doc_id", "text").select("doc_id", F.xxhash64(text).alias("h"), text.alias("text"))


def _found(docs: DataFrame) -> DataFrame:
    """(doc_id, h, base, entities, words): base spans, and for texts that have one their distinct entities and words."""
    d = _texts(docs).select("doc_id", "h", "text", base_spans(F.col("text")).alias("base"))
    any_base, none = F.size("base") > 0, F.array().cast("array<string>")
    entities = F.when(any_base, F.array_distinct(F.transform("base", _entity))).otherwise(none)
    words = F.when(any_base, _words(F.col("text"))).otherwise(none)
    return stage(d.select("doc_id", "h", "base", entities.alias("entities"), words.alias("words")), "pii-found")


def _few(df: DataFrame, size: str) -> DataFrame:
    """``df``, broadcast where it is joined if it is small; ``size`` is SQL for the bytes of a row."""
    return F.broadcast(df) if (df.agg(F.sum(F.expr(size))).first()[0] or 0) <= FEW_BYTES else df


def _set_of_texts() -> Column:
    """Names the set of texts in a group, by sums of halves of two hashes, which can't overflow."""
    h = F.col("h")
    return F.struct(*(F.sum(half).alias(f"s{i}") for i, half in enumerate(y for x in (h, F.xxhash64(h)) for y in (F.shiftright(x, 32), x.bitwiseAND(0xFFFFFFFF)))))


def disclosing(docs: DataFrame, found: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """Each ``term`` whose pointwise mutual information with an entity reaches ``disclosure`` of the entity's information content.

    Frequencies count documents of the whole corpus.  No pair is too rare: personal
    data are mostly in one document.  Entities of the same texts are counted as
    one, and so are terms.
    """
    total = float(max(found.count(), 1))
    of_h = found.where(F.size("base") > 0).select("h", F.explode("entities").alias("entity")).groupBy("h", "entity").agg(F.count("*").alias("m"))
    of_h = stage(of_h, "pii-entities")
    of_entity = of_h.groupBy("entity").agg(F.sum("m").alias("n_entity"), _set_of_texts().alias("e_set")).where(F.col("n_entity") < total)
    # a term's n_both is at most n_entity, so more documents than these can't reach the threshold
    most = F.pow("n_entity", F.lit(disclosure)) * total ** (1 - disclosure) * (1 + 1e-9)
    entities = stage(of_h.join(of_entity, "entity").select("h", "m", "n_entity", "e_set", most.alias("most")).distinct(), "pii-entity-sets")
    bound = entities.agg(F.max("most")).first()[0] or 0.0

    # counted before they are joined: a term that half the corpus has is one row
    n_term = _texts(docs).select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")).where(F.col("n_term") <= bound)
    in_h = found.where(F.size("base") > 0).select("h", F.explode("words").alias("term")).distinct()
    of_term = stage(in_h.groupBy("term").agg(_set_of_texts().alias("t_set")).join(n_term, "term"), "pii-terms")
    terms = in_h.join(of_term, "term").select("h", "n_term", "t_set").distinct()

    together = entities.join(terms, "h").where(F.col("n_term") <= F.col("most"))
    together = together.groupBy("e_set", "n_entity", "t_set", "n_term").agg(F.sum("m").alias("n_both"))
    pmi = F.log2(F.col("n_both") * F.lit(total) / (F.col("n_term") * F.col("n_entity")))
    content = F.log2(F.lit(total) / F.col("n_entity"))
    reached = together.where(pmi >= disclosure * content).select("t_set", "n_term").distinct()
    return of_term.join(reached, ["t_set", "n_term"], "left_semi").select("term")


def _occurrences(docs: DataFrame, found: DataFrame, reveal: DataFrame) -> DataFrame:
    """(h, terms): spans of all occurrences of the terms outside base spans, in order, for each distinct text that has one."""
    reveal = _few(reveal, "64L + octet_length(term)")
    hit = _texts(docs).select("h", F.explode(_words(F.col("text"))).alias("term")).join(reveal, "term", "left_semi").select("h").distinct()
    hit = _few(stage(hit, "pii-hit"), "64L")
    texts = _texts(docs).join(hit, "h", "left_semi").select("h", "text").dropDuplicates(["h"])
    words = F.regexp_extract_all("text", F.lit(r"\p{L}++"), F.lit(0))
    gaps = F.split("text", r"\p{L}++", -1)
    parts = texts.select("h", F.posexplode(F.arrays_zip(F.slice(gaps, 1, F.size(words)).alias("g"), words.alias("v"))).alias("at", "x"))
    # where a word ends is a running sum, which takes time in proportion to the text
    end = F.sum(F.char_length("x.g") + F.char_length("x.v")).over(Window.partitionBy("h").orderBy("at")).cast("int")
    spans = parts.select("h", F.col("x.v").alias("v"), end.alias("e")).where(F.char_length("v") >= TERM_LETTERS).withColumn("term", F.lower("v")).join(reveal, "term", "left_semi")
    spans = spans.select("h", (F.col("e") - F.char_length("v")).alias("s"), "e", "v")
    base = found.where(F.size("base") > 0).select("h", "base").dropDuplicates(["h"]).select("h", F.explode("base").alias("b")).select("h", "b.s", "b.e", F.lit(None).cast("string").alias("v"))
    # inside a base span: the furthest end of those that begin no later is no nearer than the term's
    order = Window.partitionBy("h").orderBy("s", F.col("v").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    cover = F.max(F.when(F.col("v").isNull(), F.col("e"))).over(order)
    out = spans.union(base).withColumn("cover", cover).where("v IS NOT NULL AND (cover IS NULL OR cover < e)")
    span = F.struct(F.lit(KINDS.index("term")).alias("kind"), "s", "e", "v")
    return out.groupBy("h").agg(F.array_sort(F.collect_list(span)).alias("terms"))


def find(docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """(doc_id, h, spans): all spans of each row, base kinds first, then every occurrence of a disclosing term outside them.

    A term that discloses an entity does so in any document, with the entity or without.
    ``h`` is xxhash64 of the text, which tells rows that share a doc_id apart.
    Null texts count as empty and have no span.
    """
    found = _found(docs)
    reveal = stage(disclosing(docs, found, disclosure), "pii-disclosing")
    own = stage(_occurrences(docs, found, reveal), "pii-occurrences")
    own = _few(own, "aggregate(terms, 64L, (n, x) -> n + 64 + octet_length(x.v))").select(F.col("h").alias("h2"), "terms")
    terms = F.coalesce("terms", F.array().cast(f"array<{_SPAN}>"))
    return found.join(own, F.col("h") == F.col("h2"), "left").select("doc_id", "h", F.concat("base", terms).alias("spans"))


def digest(spans: Column, base_only: bool) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    s = F.filter(spans, lambda x: x["kind"] < 4) if base_only else spans
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(s, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))))


def redact(text: Column, spans: Column) -> Column:
    """The text with base spans generalised to their kind and disclosing terms removed to ``<TERM>``; overlaps become one."""
    tags = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("ne"), x["kind"].alias("kind"))))
    move = lambda at, x: F.greatest(at, -x["ne"])

    def piece(at: Column, x: Column, kept: Column) -> Column:
        # places count from where the block began; a substring of the whole text would be sought from its start each time
        gap = F.substring(kept["t"], at - kept["from"] + 1, F.greatest(x["s"] - at, F.lit(0)))
        return F.when(x["s"] >= at, F.concat(gap, F.element_at(tags, x["kind"] + 1))).otherwise("")

    held = lambda at, end: F.struct(at.alias("from"), F.substring(text, at + 1, end - at).alias("t"))
    tail = lambda o: F.substring(text, F.aggregate(o, F.lit(0), move) + 1, F.char_length(text))
    done = _let(ordered, lambda o: F.concat(F.array_join(_running(o, move, piece, "string", held), ""), tail(o)))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """``docs`` with personal data in ``text`` generalised or removed; n_chars, where there is one, follows the text.

    Rows without a span keep their text; null texts stay null.
    Other columns stay, but for those whose names clash.
    """
    docs = unclash(docs, ["doc_id", "text"])
    hit = find(docs, disclosure).where(F.size("spans") > 0).dropDuplicates(["doc_id", "h"])
    hit = stage(hit.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "spans"), "pii-spans")
    hit = _few(hit, "aggregate(spans, 64L, (n, x) -> n + 64 + octet_length(x.v))")
    joined = docs.join(hit, docs["doc_id"].eqNullSafe(hit["_d"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == hit["_h"]), "left")
    new = F.when(hit["spans"].isNotNull(), redact(docs["text"], hit["spans"])).otherwise(docs["text"])
    out = joined.select(*(docs[c] for c in docs.columns if c != "text"), new.alias("text")).select(*docs.columns)
    if dict(docs.dtypes).get("n_chars") == "bigint":
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return out


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row."""
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return find(docs).select("doc_id", *map(n, range(4)), F.sha2(digest(F.col("spans"), True), 256).alias("base_sha256"), digest(F.col("spans"), False).alias("spans"))
