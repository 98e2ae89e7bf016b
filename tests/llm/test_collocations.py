"""Collocations against a brute-force count, and the stack over cut batches."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from papyra.llm import collocations as C
from tests.llm import fixtures


def brute(rows, max_n=3, least=10, contained=50, top=2000):
    f, size = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            size[lang] += len(w)
            f.update((lang, tuple(w[i : i + d])) for d in range(1, max_n + 1) for i in range(len(w) - d + 1))
    cand = {k: n for k, n in f.items() if len(k[1]) > 1 and n >= least}
    out = {}
    for (lang, p), a in cand.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q)))
        if any(g == lang and len(q) > len(p) and 100 * b >= contained * a and inside(q) for (g, q), b in cand.items()):
            continue
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, size[lang], -s) for lang, rows in out.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top]))


def random_rows(seed, n=150):
    rng = random.Random(seed)
    words = ["a", "b", "A", "c", "é", "\x00", "a\x00", "a\x01", "\x01", "\x01\x02", "日本", "ab"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ", ", "\n", "\x0b"]) for _ in range(rng.randint(0, 25))), rng.choice(["en", "de", None, "und", ""])) for _ in range(n)]
    return rows + [(None, "en"), ("", None), (" ,. ", "fr"), ("the the the the " * 40, "en"), ("x y z. " * 12, "fr")]


@pytest.mark.parametrize("part,seen,group,top", [(500_000, 4, 8 << 20, 2000), (20, 1, 300, 2000), (3, 1, 50, 4), (100, 1, 4000, 2000)])
def test_matches_brute_force(spark, monkeypatch, part, seen, group, top):
    monkeypatch.setattr(C, "PART", part)
    monkeypatch.setattr(C, "SEEN", seen)
    monkeypatch.setattr(C._grouped, "__defaults__", (group,))
    rows = random_rows(part)
    df = spark.createDataFrame([(t, lang, 1, "c", "c") for t, lang in rows], "text string, lang string, n long, key string, phrase string").repartition(3)
    got = sorted(map(tuple, C.collocations(df, top=top).collect()))
    assert got == brute(rows, top=top) and got


def test_other_lengths_and_large_counts(spark):
    rows = random_rows(7, 60)
    df = spark.createDataFrame(rows, "text string, lang string")
    got = sorted(map(tuple, C.collocations(df, max_n=4, least=3, contained=80, top=None).collect()))
    assert got == brute(rows, 4, 3, 80, 10**9)
    a, parts = 3 * 10**13, 4 * 10**13
    one = spark.createDataFrame([(a, parts)], "a long, l long").selectExpr("(CAST(1000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0))) DIV (CAST(l AS DECIMAL(15, 0)) * CAST(l AS DECIMAL(15, 0)))")
    assert one.first()[0] == 10**6 * a * a // parts**2


def test_buckets_cut_anywhere_count_alike(monkeypatch):
    rng = random.Random(1)
    rows, want = [], Counter()
    for bucket in sorted({f"en\0{rng.choice('abcdef')}\0{rng.choice(['', '', '1:0', '1:7', '2:1'])}" for _ in range(40)}):
        for _ in range(rng.randint(1, 5)):
            items = [(rng.choice("xyz"), rng.choice(["x", "y", ""]), rng.randint(1, 4)) for _ in range(rng.randint(1, 6))] + [("", "", 2)]
            rows.append({"bucket": bucket, "items": "".join(f"{a}\0{b}\0{n}\0" for a, b, n in items)})
            key, _, tag = bucket.rpartition("\0")
            for a, b, n in items:
                for d, k in enumerate([key, f"{key}\0{a}", f"{key}\0{a}\0{b}"]):
                    if d == 0 or a and d == 1 or a and b:
                        want[k, int(tag[:1] or 0) > d, bucket] += n
    want = Counter(x for x in ((k, n, p) for (k, p, _), n in want.items()) if x[2] or x[1] >= 5)
    for part in (1, 3, 1000):
        monkeypatch.setattr(C, "PART", part)
        for size in (1, 2, 3, 7, 1000):
            batches = [pa.RecordBatch.from_pylist(rows[i : i + size]) for i in range(0, len(rows), size)]
            assert Counter(tuple(r.values()) for b in C.counter(3, 5)(iter(batches)) for r in b.to_pylist()) == want


def test_query_on_empty_and_odd_tables(spark, tmp_path):
    fixtures.empty(spark).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert C.query(spark, f"{tmp_path}/a").collect() == []
    fixtures.frame(spark).write.parquet(f"{tmp_path}/b/documents.parquet")
    got = sorted(map(tuple, C.query(spark, f"{tmp_path}/b").collect()))
    assert got == brute([(t, lang) for _, t, lang, *_ in fixtures.documents()]) and got
