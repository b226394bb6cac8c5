"""From raw documents to token ids: five stages, each written as Parquet and reread by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nasaq.llm import bpe, decontaminate, language_id, near_dedup, pii
from nasaq.llm.frames import _STAGED, clean, crc_bucket, shared_dir, stage, unclash

#: A document whose language has less than this share of it is rejected.
LANGUAGE_SHARE = 0.5


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; those without letters, or without a main language, go.

    The model learns from documents with a ``lang`` (all but one crc32 class of
    four, as op2 does); ``lang`` is no input of the decision.
    """
    docs = unclash(docs, ["doc_id", "text", "lang"])
    model = language_id.train(docs.where(crc_bucket("doc_id", 4) != 2))
    seen = language_id.predict(docs, model)
    return seen.where((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SHARE)).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near copies (five-word shingles, Jaccard 0.8).

    Texts decide, not ids: rows without a doc_id are compared as all others and
    stay only where no copy has one; different texts under one doc_id are
    different documents.  Rows whose text has no word are no copies and stay,
    but for those that repeat both doc_id and text.
    """
    docs = unclash(docs, ["doc_id", "text"])
    unsure = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id IS NULL OR n > 1")
    if unsure.isEmpty():  # each id names a row
        gone = near_dedup.groups(docs, width=5, percent=80).where("NOT kept").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)

    # one row for each distinct text, named by the text's hash
    worded = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    row, first = F.struct(*docs.columns), F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")
    one = docs.where(worded).groupBy(F.xxhash64("text").alias("h")).agg(F.min_by(row, first).alias("row"), F.min(first).alias("first"))
    one = stage(one, "pipeline-texts")
    of = near_dedup.groups(one.select(F.col("h").alias("doc_id"), F.col("row.text").alias("text")), width=5, percent=80).select(F.col("doc_id").alias("h"), "component_id")
    kept = one.select("h", "first").join(of, "h").groupBy("component_id").agg(F.min_by("h", F.struct("first", "h")).alias("h")).select("h")
    rest = docs.where(~worded)
    named = rest.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
    return one.join(kept, "h", "left_semi").select("row.*").union(named).union(rest.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; those that contain one go."""
    docs = unclash(docs, ["doc_id", "text"])
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_items(docs, items).where(F.size("item_ids") == 0).select(*docs.columns)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data generalised and disclosing terms removed from their texts."""
    return pii.sanitise(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of tokens, and digests of its ids and of the bytes decoded from them."""
    return bpe.round_trip(docs)


STAGES = [("language_id", keep_languages), ("near_dedup", keep_one_of_each), ("decontamination", drop_contaminated), ("pii", sanitise), ("byte_bpe", encode)]

#: Learning a language model, edit groups and byte-pair merges are not expressible in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/nasaq/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        _STAGED.append((spark, path))
        docs = spark.read.parquet(path)
        clean(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
