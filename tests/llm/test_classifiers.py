"""Language ID, toxicity, quality: brute force on small texts, learning, odd cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from papyra.llm import bytetools, features, langid, quality, toxicity
from papyra.llm.common import fold, labelled_sample
from tests.llm.fixtures import documents, empty, frame


def test_word_hashes_depend_on_content_only():
    texts = ["Alpha beta", "xx alpha-BETA alpha", None, "", "a" * 50]
    data, offsets = bytetools.buffers(pa.array(texts))
    table = bytetools.fold_map()
    s, e, rows = bytetools.words(data, offsets, table)
    assert [bytes(data[a:b]).decode() for a, b in zip(s, e)] == ["Alpha", "beta", "xx", "alpha", "BETA", "alpha", "a" * 50]
    assert rows.tolist() == [0, 0, 1, 1, 1, 1, 4]
    h = bytetools.span_hashes(data, s, e, table)
    assert h[0] == h[3] == h[5] and h[1] == h[4] and len(set(h.tolist())) == 4


def test_spans_across_segments_and_longer_than_one():
    long = "q" * (3 * bytetools.SEGMENT)
    text = "word " * 300_000 + long + " word " + long
    data, offsets = bytetools.buffers(pa.array([text]))
    s, e, _ = bytetools.words(data, offsets, bytetools.fold_map())
    h = bytetools.span_hashes(data, s, e, bytetools.fold_map())
    assert len(set(h.tolist())) == 2 and h[-1] == h[-3]


def brute_bits(train: list[str], text: str) -> float:
    """Code length by nested dictionaries, straight from the definition."""
    A = langid.A
    n3, n2, n1 = Counter(), Counter(), Counter()
    for t in train:
        s = [0, 0, *langid.SYMBOLS[np.frombuffer(t.encode(), np.uint8)].tolist()]
        for a, b, c in zip(s, s[1:], s[2:]):
            n3[a, b, c] += 1
            n2[b, c] += 1
            n1[c] += 1
    bits = 0.0
    s = [0, 0, *langid.SYMBOLS[np.frombuffer(text.encode(), np.uint8)].tolist()]
    for a, b, c in zip(s, s[1:], s[2:]):
        def stats(counts, prefix):
            own = {k[-1]: v for k, v in counts.items() if k[:-1] == prefix}
            return own, sum(own.values()), len(own)

        kinds, total = len(n1), sum(n1.values())
        p = (n1[c] if n1[c] else kinds / A) / (total + kinds)
        own, n, t = stats(n2, (b,))
        if n:
            p = own[c] / (n + t) if c in own else t / (n + t) * p
        own, n, t = stats(n3, (a, b))
        if n:
            p = own[c] / (n + t) if c in own else t / (n + t) * p
        bits -= math.log2(p)
    return bits


def test_ppm_code_lengths_match_brute_force(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 7)
    sets = {"a": ["the cat and the hat", "then"], "b": ["der hut und die katze", "ß ü"]}
    counts = []
    for name in sorted(sets):
        data, offsets = bytetools.buffers(pa.array(sets[name]))
        c, n = np.unique(np.concatenate([langid.codes(data, offsets, lo, min(lo + 7, len(data))) for lo in range(0, len(data), 7)]), return_counts=True)
        counts.append((c.astype(np.int64), n.astype(float)))
    m = langid.Model(sorted(sets), counts, [1, 1])
    texts = ["the hut", "", "Zebra 99!", "ü und then ¿", "x" * 40]
    got = m.bits(*bytetools.buffers(pa.array(texts)), m.index())
    for i, t in enumerate(texts):
        for k, name in enumerate(sorted(sets)):
            assert got[i, k] == pytest.approx(brute_bits(sets[name], t), rel=1e-5, abs=1e-6)


def test_language_query_on_odd_rows(spark):
    docs = frame(spark)
    rows = langid.identify(docs, langid.train(docs), out="o").select("doc_id", "text", "lang", "o.lang", "o.score").toDF("doc_id", "text", "true", "pred", "score").collect()
    assert len(rows) == len(documents())
    for r in rows:
        assert 0 <= r["score"] <= 1
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert (r["pred"], r["score"]) == ("und", 0.0)
    long = [r for r in rows if r["text"] and len(r["text"]) > 60]
    assert sum(r["pred"] == r["true"] for r in long) >= 0.95 * len(long)


def test_language_without_training_rows(spark):
    docs = frame(spark)
    out = langid.identify(docs, langid.train(empty(spark)), out="o").select("o.lang").distinct().collect()
    assert [r[0] for r in out] == ["und"]
    assert langid.identify(empty(spark), langid.train(docs)).count() == 0


def test_folds_use_crc32_of_the_id(spark):
    rows = spark.range(50).select("id", fold(F.col("id"), 4, 2).alias("f")).collect()
    assert all(r["f"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


def _lists(texts, extract):
    data, offsets = bytetools.buffers(pa.array(texts))
    out = []
    for i, j, rows, b in features.pairs(data, offsets, extract):
        cuts = np.searchsorted(rows, np.arange(i, j + 1))
        out += [b[a:z].astype(np.int32) for a, z in zip(cuts[:-1], cuts[1:])]
    return out


def test_machine_learns_a_pair_that_no_part_shows():
    rng = np.random.default_rng(0)
    texts, y = [], []
    for _ in range(1500):
        a, b = rng.integers(0, 2, 2)
        texts.append(" ".join(["idiot"] * a + ["people"] * b + [f"w{rng.integers(0, 30)}"]))
        y.append(int(a and b))
    texts += ["x idiot", "x people"] * 3
    y += [0] * 6
    m = toxicity.FM(_lists(texts, features.terms), np.array(y), epochs=40)
    s = m.score(*bytetools.buffers(pa.array(["idiot people", "idiot", "people", "", None])), m.table())
    assert s[0] > 0.8 and max(s[1:]) < 0.3 and s[3] == s[4]


def test_quality_separates_shapes_and_descent_is_optimal():
    good = ["The cat sat on the mat. It was warm and dry today."] * 20
    bad = ["THE!! CAT!! SAT!! ON!! MAT!!", "aa aa aa aa aa aa aa aa", "a$$$ b&&& c*** d%%%"] * 10
    y = np.array([1] * 20 + [0] * 30)
    m = quality.NBSVM(_lists(good + bad, features.ngrams), y)
    s = m.score(*bytetools.buffers(pa.array(["The dog ran on the road. He was fast.", "DOG!! RAN!! FAR!!", "zz zz zz zz zz zz"])))
    assert s[0] > 0.7 and s[1] < 0.5 and s[2] < 0.5
    x = np.array([[1.0, 1], [2, 1], [-1, 1], [-1.5, 1], [0.2, 1]])
    t = np.array([1, 1, -1, -1, -1])
    w = quality.descend([np.array([0, 1])] * 5, list(x), t, 2, 1.0, epochs=400)
    up = np.where(t > 0, 5 / 4, 5 / 6)
    loss = lambda w: 0.5 * w @ w + (up * np.maximum(0, 1 - t * (x @ w))).sum()
    grid = min(loss(np.array([a, b])) for a in np.linspace(-2, 2, 201) for b in np.linspace(-2, 2, 201))
    assert loss(w) <= grid + 1e-3


def test_one_class_or_no_labels():
    for cls in (toxicity.FM, quality.NBSVM):
        none = cls([], np.zeros(0, np.int64))
        one = cls([np.array([1], np.int32)], np.array([1]))
        args = bytetools.buffers(pa.array(["a", None]))
        more = lambda m: (m.table(),) if cls is toxicity.FM else ()
        assert none.score(*args, *more(none)).tolist() == [0.0, 0.0] and one.score(*args, *more(one)).tolist() == [1.0, 1.0]


def test_label_sample_leaves_out_the_held_out_fold(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(i % 80, i % 2, None if i == 3 else i % 80 % 2) for i in range(160)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    sample, sizes = labelled_sample(docs, labels, "toxic", 1000)
    rows = sample.collect()
    assert rows and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 for r in rows) and set(sizes) == {0, 1}
    assert labelled_sample(docs, labels.limit(0), "toxic", 10)[0].count() == 0
    m = toxicity.train(docs, labels)
    got = docs.select(toxicity.scorer(spark, m)("text").alias("s")).collect()
    assert all(0 <= r["s"] <= 1 for r in got)
    m = quality.train(docs, labels)
    got = docs.select(quality.scorer(spark, m)("text").alias("s")).collect()
    assert all(0 <= r["s"] <= 1 for r in got)


def test_sample_is_bounded_by_rows_not_ids(spark):
    """Ten ids, each with many texts, and one row many times over."""
    rows = spark.range(20_000).selectExpr("id % 10 AS doc_id", "concat('text number ', IF(id % 2 = 0, 0, id)) AS text", "'en' AS lang")
    labels = spark.range(10).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality", "CAST(id % 2 AS INT) AS toxic")
    sample, _ = labelled_sample(rows, labels, "quality", 100)
    got = sample.collect()
    assert 20 < len(got) < 300 and len({(r["doc_id"], r["text"]) for r in got}) == len(got)
    lists, y = features.collect_features(sample, features.terms)
    assert len(lists) == len(y) == len(got) and set(y) <= {0, 1}
    assert langid.train(rows, 50).langs == ["en"]


def brute_terms(text):
    """Buckets of folded words and beginnings of long ones."""
    out = set()
    for w in re.findall(rb"[a-z0-9\x80-\xff]+", "".join(c.lower() if c.isascii() else c for c in text or "").encode()):
        for k, part in ((1, w), (2, w[:6])):
            if k == 1 or len(w) > 6:
                out.add(bucket_of(part, k))
    return out


def mixed(h):
    M = (1 << 64) - 1
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & M
    h = (h ^ h >> 27) * 0x94D049BB133111EB & M
    return h ^ h >> 31


def hash_of(part):
    return mixed(sum(c * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(part)) % (1 << 64))


def bucket_of_number(h, salt):
    return mixed((h ^ salt * 0x632BE59BD9B4E019) % (1 << 64)) >> (64 - features.BITS)


def bucket_of(part, salt):
    return bucket_of_number(hash_of(part), salt)


ODD = ["Die Idioten und the people", "", None, "x", "groups groups GROUPS", "!!! aa aa bb, Cc. 12 é", "longest beginnings matter " * 3]


def test_machine_score_matches_brute_force():
    """Every pair of terms, one by one."""
    texts = [t for r in documents() if (t := r[1])] * 2
    y = np.array([int("the" in t.split()) for t in texts])
    m = toxicity.FM(_lists(texts, features.terms), y, shift=0.3, epochs=3)
    at = {int(b): k for k, b in enumerate(m.buckets)}
    for t, got in zip(ODD + texts[:20], m.score(*bytetools.buffers(pa.array(ODD + texts[:20])), m.table())):
        own = sorted(at[b] for b in brute_terms(t) if b in at)
        z = m.bias + sum(m.w[i] for i in own) + sum(float(m.v[i] @ m.v[j]) for i in own for j in own if i < j)
        assert got == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def brute_ngrams(text):
    raw = (text or "").encode()
    out = set()
    w = [hash_of(x) for x in re.findall(rb"[a-z0-9\x80-\xff]+", bytes(c + 32 if 65 <= c <= 90 else c for c in raw))]
    out |= {bucket_of_number(h, 3) for h in w} | {bucket_of_number((b * 31 + a) % (1 << 64), 4) for a, b in zip(w, w[1:])}
    kind = lambda c: 0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if c in b",." else 5 if c >= 128 else 4
    tokens = re.findall(rb"[^ \t\n\r\x0b\x0c\x00]+", raw)
    u = [((kind(x[0]) * 6 + kind(x[min(1, len(x) - 1)])) * 6 + kind(x[-1])) * 2 + (k > 0 and x == tokens[k - 1]) + 1 for k, x in enumerate(tokens)]
    out |= {bucket_of_number(x, 5) for x in u} | {bucket_of_number(a * 512 + b, 6) for a, b in zip(u, u[1:])}
    return out | {bucket_of_number((a * 512 + b) * 512 + c, 7) for a, b, c in zip(u, u[1:], u[2:])}


def test_quality_score_matches_brute_force(monkeypatch):
    texts = [t for r in documents() if (t := r[1])]
    y = np.array([int(len(t) > 200) for t in texts])
    m = quality.NBSVM(_lists(texts, features.ngrams), y, shift=-0.2)
    # scaling by log-count ratios, from the definition
    has = [brute_ngrams(t) for t in texts]
    p, q = Counter(b for h, k in zip(has, y) if k for b in h), Counter(b for h, k in zip(has, y) if not k for b in h)
    size = [sum(c.values()) + features.BUCKETS for c in (p, q)]
    for size_of_group in (40, features.GROUP):
        monkeypatch.setattr(features.groups, "__defaults__", (size_of_group,))
        for t, got in zip(ODD + texts[:30], m.score(*bytetools.buffers(pa.array(ODD + texts[:30])))):
            own = [b for b in brute_ngrams(t) if p[b] + q[b] >= 3]
            ratio = {b: math.log((p[b] + 1) / size[0]) - math.log((q[b] + 1) / size[1]) for b in own}
            for b in own:
                assert m.square[b] == pytest.approx(ratio[b] ** 2, rel=1e-5)
            norm = math.sqrt(sum(r * r for r in ratio.values()))
            z = sum(float(m.weight[b]) for b in own) / norm if norm else 0.0
            assert got == pytest.approx(1 / (1 + math.exp(-(m.slope * (z + m.bias) + m.offset))), abs=1e-6)


@pytest.mark.parametrize("op", [toxicity, quality])
def test_queries_on_odd_tables(spark, tmp_path, op):
    """An empty table, clashing extra columns, a very long text, repeated rows."""
    labels = spark.createDataFrame([(i, i % 2, i % 2, 9.0) for i in range(50)], "doc_id long, quality int, toxic int, score double")
    rows = documents() + [(200, "word " * 200_000, "en", "s", 1, "c", "c", "c", "c", "c")]
    for name, df in (("a", empty(spark)), ("b", frame(spark, rows).withColumn("held_out", F.lit("x")).withColumn("predicted", F.lit("x")).withColumn("h", F.lit("x")))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = op.query(spark, f"{tmp_path}/{name}").collect()
        assert len(got) == (0 if name == "a" else len(rows))
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= op.THRESHOLD) for r in got)
        scores = {}
        for r in got:
            scores.setdefault(r["doc_id"], set()).add(r["score"])
        if name == "b":
            assert scores[100] == scores[101] and all(len(s) == 1 for s in scores.values())
