"""Decontamination against brute force and SQL; the pipeline against its parts."""

import collections
import hashlib
import random
import re

import duckdb
import pytest

from papyra.llm import decontaminate as D
from papyra.llm import langid, quality
from tests.llm.fixtures import WORDS, documents, empty, frame, sentence


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def items():
    rng = random.Random(8)
    out = [(i, sentence(rng, "en", 25)) for i in range(6)]
    out += [(10, "rare short phrase"), (11, "x"), (12, None), (13, "!!!"), (14, "É Straße 日本"), (15, out[0][1]), (15, out[0][1]), (None, "nameless item words"), (16, "the the the the the the the the the the the")]
    return out


def planted():
    own = items()
    rows = [(500, "Start " + own[0][1].upper() + " end"), (501, "a RARE, short—phrase. rare short phrase x"), (502, own[1][1][:90]), (503, "É Straße 日本 é straße 日本"), (504, "the " * 30), (505, own[2][1] + " " + own[2][1]),
            (506, "-nameless item words-"), (507, own[3][1] + " " + own[4][1]), (508, " ".join(own[0][1].split()[9::-1])), (509, "phrase, so short and so rare")]
    return documents() + [(i, t, "en", "s", len(t), "c", "c", "c", "c", "c") for i, t in rows]


def brute(rows, own):
    wins = {}
    for i, t in own:
        w = words(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[s : s + n]), set()).add(i)
    count = collections.Counter(w for r in rows for w in words(r[1]))
    rarest = {k: min((count[x], o) for o, x in enumerate(k))[1] for k in wins}
    out = []
    for r in rows:
        w, hit, found, near = words(r[1]), set(), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[k] - {None}
        for k, ids in wins.items():
            if any(x == k[rarest[k]] and set(k) <= set(w[max(0, p - 9) : p + 10]) for p, x in enumerate(w)):
                near |= ids - {None}
        listed = ",".join(sorted(map(str, found)))
        out.append((r[0], len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit), len(near)))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


@pytest.mark.parametrize("most", [500_000, 7])
def test_matches_brute_force(spark, monkeypatch, most):
    for f in (D.index, D.anchors, D.matches):
        monkeypatch.setattr(f, "__defaults__", tuple(most if x == D.BROADCAST else x for x in f.__defaults__))
    bench = spark.createDataFrame(items(), "item_id long, text string").selectExpr("*", "1 AS term", "2 AS doc_id")
    got = D.decontaminate(frame(spark, planted()), bench).collect()
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute(planted(), items()), key=key)


def test_empty_sides(spark):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    got = D.decontaminate(frame(spark), bench.limit(0)).collect()
    assert len(got) == len(documents()) and not any(r["contaminated"] for r in got)
    assert D.decontaminate(empty(spark), bench).count() == 0


def test_proximity_finds_terms_in_any_order(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "gamma then beta and alpha"), (2, "alpha beta " + "x " * 30 + "gamma"), (3, "alpha beta gamma")], "doc_id long, text string")
    rows, found, _ = D.search(docs, bench)
    got = {(r["doc_id"], r["exact"]) for r in rows.join(found, "rid").collect()}
    assert got == {(1, False), (3, True)}


def test_a_frequent_word_and_a_long_text(spark):
    """One word many times over, in one row and in many."""
    bench = spark.createDataFrame([(1, "so so so"), (2, "so it goes on and on like that for ever and a day")], "item_id long, text string")
    rows = [(i, "so " * 40) for i in range(20)] + [(30, "so " * 5000 + "it"), (31, "x " * 9000 + "so it goes on and on like that for ever and a day")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in D.decontaminate(docs, bench).collect())
    assert got == sorted(brute(rows, [(1, "so so so"), (2, "so it goes on and on like that for ever and a day")]))


def test_no_python_on_the_main_path(spark):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    plan = D.decontaminate(frame(spark), bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)


def test_sql_says_the_same(spark, tmp_path):
    frame(spark, planted()).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items(), "item_id long, text string").where("item_id IS NOT NULL").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(D.ORACLE).fetchall()
    got = [tuple(r) for r in D.query(spark, str(tmp_path)).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(1)
    rows = [(i, sentence(rng, "en" if i % 2 else "de", 60), "en" if i % 2 else "de") for i in range(80)]
    rows += [(200 + i, " ".join(w.upper() + "!!" for w in sentence(rng, "en", 40).split()), "en") for i in range(40)]
    rows += [(300, rows[0][1], "de"), (301, rows[0][1], "de"), (302, "leak " + items()[0][1], "en"), (303, None, None), (304, "", None), (305, rows[5][1], "en"), (305, rows[5][1], "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), "c", "c", "c", "c", "c") for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, fp string, key string, score string, y string, th string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, _, _ in rows if i < 300], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items(), "item_id long, text string").where("item_id < 10").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = str(tmp_path)
    now = spark.read.parquet(f"{sf}/documents.parquet")
    names = now.columns
    kept = {}
    for k, (name, stage) in enumerate(P.STAGES):
        now = stage(spark, now, sf)
        if k < 4:
            assert now.columns == names
            now.write.parquet(f"{sf}/s{k}")
            now = spark.read.parquet(f"{sf}/s{k}")
            kept[name] = sorted(r["doc_id"] for r in now.collect())
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = docs.select("doc_id", quality.scorer(spark, model)("text").alias("s")).collect()
    assert kept["quality"] == sorted(r["doc_id"] for r in scores if r["s"] >= quality.THRESHOLD)
    assert not any(200 <= i < 300 for i in kept["quality"]) and set(range(80)) <= set(kept["quality"])
    assert not {303, 304} & set(kept["language"]) and set(range(80)) <= set(kept["language"])
    assert not {300, 301, 305} & set(kept["near_dedup"]) and len(set(kept["near_dedup"])) == len(kept["near_dedup"])
    assert 302 not in kept["decontaminate"] and set(kept["decontaminate"]) == set(kept["near_dedup"]) - {302}
    assert {r["doc_id"] for r in now.collect()} == set(kept["decontaminate"])
    assert P.run(spark, sf).count() >= len(kept["decontaminate"])
    assert WORDS and langid.train(docs).langs == ["de", "en"]


def test_pipeline_keeps_unrelated_rows_of_one_id(spark, tmp_path):
    """Repeats are rows equal in id and text; a null id is a document as any other."""
    import corpus_pipeline as P

    rng = random.Random(6)
    a, b, c, d = (sentence(rng, "en", 80) for _ in range(4))
    rows = [(5, a), (5, b), (6, c), (6, c), (None, c), (None, d), (None, d), (None, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    got = sorted(((r["doc_id"], r["text"]) for r in P.near_dedup(spark, docs, "").collect()), key=str)
    assert got == sorted([(5, a), (5, b), (6, c), (None, d), (9, "")], key=str)


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as P

    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
