"""Glossary: extraction of acronyms, both directions, merging."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

SCHEMA = "key string, expansion string, pos long"

#: The three forms of a definition, and which group is the acronym and which the expansion.
FORMS = (
    (r"\b([A-Z][A-Z0-9]{1,10})\s+\(([A-Z][a-zA-Z\s]{3,60})\)", 1, 2),
    (r"([A-Z][a-zA-Z\s]{3,60})\s+\(([A-Z][A-Z0-9]{1,10})\)", 2, 1),
    (r"\b([A-Z][A-Z0-9]{1,10})\s*[—–-]\s+([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)(?:\s|[.,;]|$)", 1, 2),
)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def from_dict(spark: SparkSession, entries: dict[str, list[str]]) -> DataFrame:
    rows = [(k, v, i * 1000 + j) for i, (k, vs) in enumerate(entries.items()) for j, v in enumerate(vs)]
    return spark.createDataFrame(rows, SCHEMA)


def definitions(texts: DataFrame, column: str = "text") -> DataFrame:
    """(acronym, expansion) of every definition in every text."""
    c = F.col(column)
    out = None
    for pattern, a, e in FORMS:
        pairs = F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(a)).alias("a"), F.regexp_extract_all(c, F.lit(pattern), F.lit(e)).alias("e"))
        one = texts.where(c.rlike(pattern)).select(F.explode(pairs).alias("p")).select(
            F.col("p.a").alias("acronym"), F.lower(F.regexp_replace(F.col("p.e"), r"\A\s+|\s+\z", "")).alias("expansion")
        )
        out = one if out is None else out.unionByName(one)
    return out


def extract(texts: DataFrame, column: str = "text") -> DataFrame:
    """(acronym, expansion) pairs, distinct over all texts."""
    return definitions(texts, column).distinct()


def both_ways(entries: DataFrame) -> DataFrame:
    """Lower-cased entries and their reverse, without repeats; order by pos."""
    low = entries.select(F.lower("key").alias("key"), F.lower("expansion").alias("expansion"), "pos")
    back = low.select(F.col("expansion").alias("key"), F.col("key").alias("expansion"), (F.col("pos") + 1_000_000_000).alias("pos"))
    return low.unionByName(back).groupBy("key", "expansion").agg(F.min("pos").alias("pos"))


def automatic(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entries found in node contents and in `title description` of documents."""
    texts = nodes.select(F.col("content").alias("text")).unionByName(documents.select(F.concat_ws(" ", "title", "description").alias("text")))
    found = extract(texts)
    w = Window.partitionBy("acronym").orderBy("expansion")
    return both_ways(found.select(F.col("acronym").alias("key"), "expansion", F.row_number().over(w).cast("long").alias("pos")))


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """All entries; those of the first come before the second's."""
    later = second.withColumn("pos", F.col("pos") + 2_000_000_000)
    return first.unionByName(later).groupBy("key", "expansion").agg(F.min("pos").alias("pos"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A glossary.json of term to list of expansions (S09); a broken or missing file gives no entries."""
    try:
        raw = spark.read.text(path, wholetext=True)
        parsed = raw.select(F.try_parse_json("value").alias("v"))
        entries = parsed.where(F.col("v").isNotNull()).select(F.explode(F.try_variant_get("v", "$", "map<string,array<string>>")).alias("key", "es"))
        rows = entries.select("key", F.posexplode("es").alias("p", "expansion"))
        return both_ways(rows.select("key", "expansion", F.col("p").cast("long").alias("pos")))
    except AnalysisException as e:  # no such file; what can't be parsed gives nulls above
        print(f"glossary not read: {e}")
        return empty(spark)


def terms(glossary: DataFrame) -> DataFrame:
    return glossary.select("key").distinct()
