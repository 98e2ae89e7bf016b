"""A training-data pipeline of five operators; each stage's rows are written and read again.

Stages: quality classifier, language ID, SimHash near-dedup, benchmark decontamination,
best-fit packing. Each takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents. Models learn from the labels of
documents.parquet's own rows, so a stage behaves alike whatever an earlier one removed.

Defined cases: a document that the quality classifier scores below its threshold goes;
so does one whose language is `und`, whose score is below MIN_LANGUAGE, or whose code is
longer than without any statistics of a language (bytes that are in none of them). Of a
group of linked near-duplicates the row with the smallest doc_id stays, a null doc_id
counting as the largest, and of several texts with that doc_id the one whose hash is
smallest; of rows equal in doc_id and text one. Rows with one doc_id and unrelated texts
are documents of their own. A document with a hit benchmark window goes. Extra columns
pass through the filters untouched. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import decontaminate, langid, packing, quality, simhash
from papyra.llm.common import beside, table
from papyra.session import attach, write_table

MIN_LANGUAGE = 0.3


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the quality classifier (9) accepts."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.where(quality.scorer(spark, model)(F.col("text")) >= quality.THRESHOLD)


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that language identification (1) knows."""
    model = langid.train(table(spark, sf_dir, "documents"))
    scored = langid.identify(docs, model, out="__lang_id")
    known = (F.col("__lang_id.lang") != "und") & (F.col("__lang_id.score") >= MIN_LANGUAGE) & (F.col("__lang_id.bits_per_byte") <= langid.UNIFORM)
    return scored.where(known).drop("__lang_id")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash group (4)."""
    attach(spark)
    found = simhash.near_duplicates(docs.select("doc_id", "text"))
    rows = found.groupBy("group_id", "doc_id", "th").agg(F.count("*").alias("n"))
    least = rows.groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "n")).alias("k"))
    kept = write_table(least.select(F.col("k.doc_id").alias("__id"), F.col("k.th").alias("__th"), F.col("k.n").alias("__n")), "kept")
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__th"))
    if not kept.where("__n > 1").limit(1).count():
        return docs.join(beside(kept), same, "left_semi")
    once = docs.join(beside(kept.where("__n = 1")), same, "left_semi")
    many = docs.join(beside(kept.where("__n > 1")), same, "left_semi")
    return once.unionByName(many.dropDuplicates(["doc_id", "text"]))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a benchmark window (10); joined by id and a hash of the text."""
    matches = decontaminate.matched(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = write_table(matches.select(F.col("did").alias("__did"), F.col("th").alias("__th")), "hit")
    key = (F.coalesce(docs["doc_id"].cast("long"), F.lit(-1)) == F.col("__did")) & (F.xxhash64(docs["text"]) == F.col("__th"))
    return docs.join(beside(hit), key, "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences (7)."""
    attach(spark)
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("quality", by_quality),
    ("language", by_language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("pack", packed),
]

#: SQL can't express the models, XXH64 and the tokenizer: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
