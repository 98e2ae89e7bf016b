"""Corpora built from the data folder's tables, as documents and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.operators import code, markdown
from papyra.operators.indexing import Index
from papyra.operators.tree import with_parents
from papyra.session import attach
from papyra.sources.files import documents_and_nodes

_kept: dict[tuple[str, str, str], object] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, make):
    """A corpus built once a session and folder; its tables are in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = make(attach(spark), sf_dir)
    return _kept[key]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows dealt by their key, before texts are made of them: a table of a few MB is one task's scan, whatever is made of it."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _document(df: DataFrame, doc_id, doc_ord, path, title, description, tags, collection, facets, references=None) -> DataFrame:
    return df.select(
        doc_id.alias("doc_id"), doc_ord.cast("long").alias("doc_ord"), path.alias("file_path"), title.alias("title"), description.alias("description"),
        F.lit(0).cast("long").alias("word_count"), F.lit(1).cast("long").alias("heading_count"), F.lit(1).alias("max_depth"), F.lit("").alias("last_modified"),
        tags.alias("tags"), F.lit("").alias("content_hash"), collection.alias("collection"), facets.alias("facets"),
        (F.array().cast("array<string>") if references is None else references).alias("references"),
    )


def _node(df: DataFrame, doc_id, doc_ord, ord_, title, level, content, node_id=None) -> DataFrame:
    return df.select(
        doc_id.alias("doc_id"), doc_ord.cast("long").alias("doc_ord"), ord_.cast("int").alias("ord"),
        (F.concat(doc_id, F.lit(":n"), ord_.cast("int") + 1) if node_id is None else node_id).alias("node_id"), title.alias("title"), level.cast("int").alias("level"),
        content.alias("content"),
    )


def _finish(nodes: DataFrame) -> DataFrame:
    return with_parents(nodes).select(
        "doc_id", "doc_ord", "ord", "node_id", "title", "level", "parent_id", "content", F.lit("").alias("summary"), T.word_count(F.col("content")).alias("word_count"),
        F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("boolean").alias("exported"), "path",
    )


def docs_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """`documents`: a node a document; lang and source are facets, lang is a tag, half are in collection `odd`."""
    d = read(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source"))
    did = F.concat(F.lit("docs:"), F.col("doc_id").cast("string"))
    coll = F.when(F.col("doc_id") % 2 == 1, F.lit("odd")).otherwise(F.lit("even"))
    facets = F.create_map(F.lit("lang"), F.array("lang"), F.lit("source"), F.array("source"))
    documents = _document(
        d, did, F.col("doc_id"), F.concat("lang", F.lit("/"), "source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".md")),
        F.concat(F.lit("Doc "), F.lpad(F.col("doc_id").cast("string"), 8, "0")), F.concat_ws(" ", "lang", "source"), F.array("lang"), coll, facets,
    )
    nodes = _node(d, did, F.col("doc_id"), F.lit(0), F.concat_ws(" ", "lang", "source"), F.lit(0), F.col("text"))
    return documents, _finish(nodes)


def docs_index(spark: SparkSession, sf_dir: str) -> Index:
    return kept(spark, sf_dir, "docs", lambda s, d: Index.build(*docs_tables(s, d), auto_glossary=False))


def conv_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """`conversations`: user turns are level 1, others level 2; contents of every third turn carry a code block."""
    c = read(spark, sf_dir, "conversations").where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    did = F.concat(F.lit("conv:"), F.col("conv_id").cast("string"))
    heads = c.select("conv_id").distinct()
    documents = _document(
        heads, did, F.col("conv_id"), F.concat(F.lit("talks/c"), F.col("conv_id").cast("string"), F.lit(".md")), F.concat(F.lit("Talk "), F.col("conv_id").cast("string")),
        F.when(F.col("conv_id") % 3 == 0, F.lit("the nicht les")).otherwise(F.lit("")), F.array().cast("array<string>"), F.lit("conv"), F.create_map().cast("map<string,array<string>>"),
    )
    body = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("[code:x] "), "text")).otherwise(F.col("text"))
    nodes = _node(c, did, F.col("conv_id"), F.col("turn"), F.concat_ws(" ", "role", F.col("turn").cast("string")), F.when(F.col("role") == "user", 1).otherwise(2), body)
    return documents, _finish(nodes)


def conv_index(spark: SparkSession, sf_dir: str) -> Index:
    return kept(spark, sf_dir, "conv", lambda s, d: Index.build(*conv_tables(s, d), auto_glossary=False))


def geo_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One document a region: the region (1), its nations (2), their suppliers (3), in order of keys."""
    r, n, s = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    did = F.concat(F.lit("geo:"), F.col("r_regionkey").cast("string"))
    parts = (
        r.select("r_regionkey", F.lit(-1).alias("n"), F.lit(-1).cast("long").alias("s"), F.col("r_name").alias("title"), F.lit(1).alias("level"), F.concat(F.lit("region "), "r_name").alias("content"))
        .unionByName(r.join(n, r.r_regionkey == n.n_regionkey).select("r_regionkey", F.col("n_nationkey").alias("n"), F.lit(-1).cast("long").alias("s"), F.col("n_name").alias("title"), F.lit(2).alias("level"), F.concat(F.lit("nation "), "n_name", F.lit(" of "), "r_name").alias("content")))
        .unionByName(r.join(n, r.r_regionkey == n.n_regionkey).join(s, s.s_nationkey == n.n_nationkey).select("r_regionkey", F.col("n_nationkey").alias("n"), F.col("s_suppkey").alias("s"), F.col("s_name").alias("title"), F.lit(3).alias("level"), F.concat(F.lit("supplier "), "s_name", F.lit(" in "), "n_name").alias("content")))
    )
    from pyspark.sql import Window

    placed = parts.withColumn("ord", F.row_number().over(Window.partitionBy("r_regionkey").orderBy("n", "s")) - 1)
    nodes = _node(placed, did, F.col("r_regionkey"), F.col("ord"), F.col("title"), F.col("level"), F.col("content"), F.concat(did, F.lit(":"), F.col("n").cast("string"), F.lit(":"), F.col("s").cast("string")))
    documents = _document(
        r, did, F.col("r_regionkey"), F.concat(F.lit("geo/"), F.lower("r_name"), F.lit(".md")), F.col("r_name"), F.lit(""), F.array(F.lit("geo")), F.lit("geo"),
        F.create_map(F.lit("category"), F.array(F.lit("geo"))), F.array(F.lit("geo/asia.md#japan"), F.lit("../europe.md"), F.lit("nowhere.md#x")),
    )
    return documents, _finish(nodes)


def geo_index(spark: SparkSession, sf_dir: str) -> Index:
    return kept(spark, sf_dir, "geo", lambda s, d: Index.build(*geo_tables(s, d), auto_glossary=False))


def md_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A markdown file a nation, with frontmatter, headings, a fence, links and an acronym."""
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    j = n.join(r, n.n_regionkey == r.r_regionkey)
    key = F.col("n_nationkey").cast("string")
    folder = F.when(F.col("n_nationkey") % 3 == 0, F.lit("guides")).when(F.col("n_nationkey") % 3 == 1, F.lit("ops/deploy")).otherwise(F.lit("misc"))
    head = F.when(F.col("n_nationkey") % 4 == 0, F.lit("")).otherwise(
        F.concat(F.lit("---\ntitle: \""), "n_name", F.lit("\"\ntags: ["), F.lower("r_name"), F.lit(", \"nation\"]\ncategory: geo\norder: "), key, F.lit("\n---\n"))
    )
    body = F.concat(
        F.lit("lost text\n# Overview\nNation "), "n_name", F.lit(" of "), "r_name", F.lit(". More about it.\n\n## Data\n```sql\nselect "), key,
        F.lit("\n```\nSee [region](../"), F.lower("r_name"), F.lit(".md#top) and [home](/index.md) or [web](https://example.com).\n\n### Terms\nNKB (Nation Key Book) and "), "n_name",
        F.lit(" here.\n"),
    )
    return j.select(
        F.concat(folder, F.lit("/n"), key, F.lit(".md")).alias("file_path"), F.concat(head, body).alias("text"), F.lit("md").alias("collection"),
        F.lit("2024-01-02 03:04:05").cast("timestamp").alias("modified"), F.col("n_nationkey").cast("long").alias("doc_ord"),
    )


def defined_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text a part: its name defined for an acronym in each of the three forms, twice, or not at all."""
    key = F.col("p_partkey").cast("string")
    short, name = F.concat(F.lit("P"), (F.col("p_partkey") % 40).cast("string")), F.initcap("p_name")
    texts = F.array(
        F.concat(F.lit("the "), short, F.lit(" ("), name, F.lit(") is listed")), F.concat(F.lit("see "), name, F.lit(" ("), short, F.lit(") too")), F.concat(short, F.lit(" — "), name, F.lit(". then")),
        F.concat(short, F.lit(" ("), name, F.lit(")\nand "), name, F.lit(" (X"), short, F.lit(")")), F.concat(F.lit("nothing of "), F.col("p_name"), F.lit(" (p1)")),
    )
    return read(spark, sf_dir, "part").select(key.alias("k"), F.col("p_partkey").alias("doc_ord"), F.get(texts, (F.col("p_partkey") % 5).cast("int")).alias("text"))


def defined_index(spark: SparkSession, sf_dir: str) -> Index:
    def make(s, d):
        t, did = defined_texts(s, d), F.concat(F.lit("def:"), F.col("k"))
        documents = _document(t, did, F.col("doc_ord"), F.concat(F.lit("d/"), F.col("k"), F.lit(".md")), F.lit("part"), F.lit(""), F.array().cast("array<string>"), F.lit("def"), F.create_map().cast("map<string,array<string>>"))
        return Index.build(documents, _finish(_node(t, did, F.col("doc_ord"), F.lit(0), F.lit("part"), F.lit(1), F.col("text"))))

    return kept(spark, sf_dir, "defined", make)


def md_tables(spark: SparkSession, sf_dir: str, mode: str = "line") -> tuple[DataFrame, DataFrame]:
    return kept(spark, sf_dir, f"md-{mode}", lambda s, d: markdown.index_markdown(md_files(s, d), mode))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file a region: imports, a class with a method a nation, a constant, a function."""
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    ident = F.regexp_replace(F.lower("n_name"), "[^a-z0-9]", "_")
    methods = n.groupBy("n_regionkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", ident.alias("m")))), lambda x: F.concat(F.lit("    def "), x["m"], F.lit("(self):\n        return "), x["n_nationkey"].cast("string"), F.lit("\n"))), "\n").alias("methods")
    )
    name = F.regexp_replace(F.initcap(F.lower("r_name")), "[^A-Za-z]", "")
    j = r.join(methods, r.r_regionkey == methods.n_regionkey)
    text = F.concat(
        F.lit("import os\nfrom math import sqrt\n\n\nclass "), name, F.lit("(object):\n"), "methods", F.lit("\n\nLIMIT = 10\n\n\ndef load_"), F.lower(name), F.lit("(a, b=1):\n    return a\n"),
    )
    return j.select(
        F.concat(F.lit("src/"), F.lower(name), F.lit(".py")).alias("file_path"), text.alias("text"), F.lit("code").alias("collection"),
        F.lit("2024-01-02 03:04:05").cast("timestamp").alias("modified"), F.col("r_regionkey").cast("long").alias("doc_ord"),
    )


# a file's text by language; @ stands for the key
MANY = {
    "ts": "import { a } from 'x';\nexport class C@ {\n  run(a: number): number {\n    return a;\n  }\n}\nexport const go@ = (a: number) => a;\n",
    "cts": "export interface I@ {\n  size: number;\n}\nenum E@ { A, B }\nexport async function load@(\n  a: string,\n): Promise<void> {\n}\n",
    "java": "package a;\nimport b.C;\n\npublic class J@ {\n  public int run(int a) {\n    return a;\n  }\n}\n",
    "go": "package m\n\ntype S@ struct {\n\tn int\n}\n\nfunc (s *S@) Run() int {\n\treturn s.n\n}\n\nconst (\n\tA = 1\n)\n\nfunc make@(a int) int {\n\treturn a\n}\n",
    "rs": "mod m {\n    pub struct P@ {\n        n: u8,\n    }\n    impl P@ {\n        pub fn new() -> u8 {\n            @\n        }\n    }\n    fn f@() {\n    }\n}\n",
    "py": "import os\n\nclass A@:\n    def run(self,\n            b: dict = {1: 2}) -> int:\n        return @\n\nTOP@ = 1\n\ndef _f@():\n    pass\n",
    "rb": "require 'x'\n\nclass R@\n  def run(a)\n  end\nend\n",
    "cpp": "#include <a.h>\n\nstruct Q@ {\n  int x;\n};\nint calc@(int a) {\n  return a;\n}\n",
}


def many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file a part, in eight languages by turns."""
    key, n = F.col("p_partkey").cast("string"), len(MANY)
    which = (F.col("p_partkey") % n).cast("int")
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), which)
    return dealt(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(
        F.concat(F.lit("many/p"), key, F.lit("."), pick(MANY)).alias("file_path"), F.replace(pick(MANY.values()), F.lit("@"), key).alias("text"), F.lit("many").alias("collection"),
        F.lit("2024-01-02 03:04:05").cast("timestamp").alias("modified"), F.col("p_partkey").cast("long").alias("doc_ord"),
    )


def twice_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A markdown file a part from one folder, and of every third part again from a second folder of the same collection, loaded later."""
    p = dealt(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.coalesce("p_name", F.lit("")).alias("name")), "k")
    key = F.col("k").cast("string")
    path, kind, when = F.concat(F.lit("parts/p"), key, F.lit(".md")), F.lit("md"), F.lit("2024-01-02 03:04:05").cast("timestamp")
    one = p.select(path.alias("file_path"), F.concat(F.lit("# Part "), key, F.lit("\nearlier "), "name", F.lit("\n\n## Old\ngonezz words\n\n## Older\nmore\n")).alias("text"), F.col("k").cast("long").alias("doc_ord"))
    two = p.where("k % 3 = 0").select(path.alias("file_path"), F.concat(F.lit("# Part "), key, F.lit("\nlater "), "name", F.lit("\n\n## New\nnewzz words\n")).alias("text"), (F.col("k") + (1 << 40)).cast("long").alias("doc_ord"))
    return one.unionByName(two).withColumns({"collection": F.lit("twice"), "kind": kind, "modified": when})


def twice_index(spark: SparkSession, sf_dir: str) -> Index:
    return kept(spark, sf_dir, "twice", lambda s, d: Index.build(*documents_and_nodes(twice_files(s, d)), auto_glossary=False))


def code_index(spark: SparkSession, sf_dir: str) -> Index:
    return kept(spark, sf_dir, "code", lambda s, d: Index.build(*code.index_code(code_files(s, d)), auto_glossary=False))
