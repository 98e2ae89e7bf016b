"""Removal of repeated windows against brute force."""

import hashlib
import random
import re

import pyarrow as pa
import pytest

from papyra.llm import substrings as S
from tests.llm import fixtures


def brute(rows, window=50):
    """(doc_id, n_words, n_removed, sha256) of rows (doc_id, text), by the definition."""
    words = [re.findall("[^ \t-\r]+", t or "") for _, t in rows]
    order = [S.NO_ID if i is None else i for i, _ in rows]
    least = {}
    for d, w in zip(order, words):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, d), d)
    out = []
    for (i, _), d, w in zip(rows, order, words):
        gone = {j for k in range(len(w) - window + 1) if least[tuple(w[k : k + window])] < d for j in range(k, k + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=120, window=5):
    """Texts of few words with common passages, copies, runs of one word, odd characters and ids."""
    rng = random.Random(seed)
    vocabulary = ["a", "b", "é", "a\x00", "日本", "A", "\x1f", "c.", *(f"w{k}" for k in range(40))]
    some = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passages = [some(window + rng.randint(0, 6)) for _ in range(4)] + [["a"] * 14]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice(passages) if rng.random() < 0.5 else some(rng.randint(0, 9))
        rows.append((rng.choice([i, i, i, 3, None]), "".join(x + rng.choice([" ", "\t", "\n", "  ", "\x0b", "\r\n"]) for x in w)))
    rows += [rows[5], rows[5], (900, rows[9][1]), (-4, rows[11][1]), (901, None), (902, ""), (903, " \n"), (904, " ".join(passages[0] * 60)), (905, " ".join(passages[0] * 70))]
    return rows


KIND = "doc_id long, text string, n long, m string, s string, doc string, spans string, low string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "c", "c", "c", "c", "c") for i, t in rows], KIND).repartition(3)


@pytest.mark.parametrize("seed,share,group,most,bits,batch", [(1, 1 << 16, 1 << 22, 500, 28, 2000), (2, 8, 64, 3, 28, 2000), (3, 64, 200, 1, 6 + 9, 7), (4, 1, 1, 2, 15, 1)])
def test_matches_brute_force(spark, monkeypatch, seed, share, group, most, bits, batch):
    for name, value in (("SHARE", share), ("GROUP", group), ("MOST_WINDOWS", most), ("MOST_BITS", bits)):
        monkeypatch.setattr(S, name, value)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rows = corpus(seed)
        got = sorted((tuple(r) for r in S.removed(frame(spark, rows), 5, 2).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == brute(rows, 5) and sum(r[2] > 0 for r in got) > 20


def test_texts_keep_their_form_where_nothing_goes(spark):
    rows = corpus(6)
    df = frame(spark, rows)
    got = S.without_repeats(df, 5, 2)
    assert got.columns == df.columns
    hashes = sorted(((r["doc_id"], hashlib.sha256(" ".join(re.findall("[^ \t-\r]+", r["text"] or "")).encode()).hexdigest()) for r in got.collect()), key=str)
    assert hashes == sorted(((i, h) for i, _, _, h in brute(rows, 5)), key=str)
    same = {(i, t) for (i, t), n in zip(rows, [0] * len(rows)) if len(re.findall("[^ \t-\r]+", t or "")) < 5}
    assert same <= {(r["doc_id"], r["text"]) for r in got.collect()}


def test_buckets_are_cut_where_minimisers_change(monkeypatch):
    rng = random.Random(2)
    rows = []
    for m in sorted(rng.sample(range(-50, 50), 30)):
        for k in range(rng.choice([1, 1, 2, 5])):
            rows.append({"m": m, "s": " ".join(f"{rng.choice('ab')}{m}" for _ in range(rng.randint(3, 9))), "low": rng.randint(0, 3), "high": rng.randint(3, 6), "n": 1, "id": b"%d-%d" % (m, k)})

    def run(size, group):
        monkeypatch.setattr(S, "GROUP", group)
        schema = pa.schema([("m", pa.int64()), ("s", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("n", pa.int64()), ("id", pa.binary())])
        batches = [pa.RecordBatch.from_pylist(rows[i : i + size], schema) for i in range(0, len(rows), size)]
        return [tuple(r.values()) for b in S.buckets(3)(iter(batches)) for r in b.to_pylist()]

    want = sorted(run(1000, 1 << 20))
    assert len(want) > 30 and all(sorted(run(size, group)) == want for size in (1, 2, 3, 5, 17) for group in (1, 40, 400))


def test_query_on_odd_and_empty_tables(spark, tmp_path):
    rows = [(i, t) for i, t, *_ in fixtures.documents()]
    rows += [(3000, rows[60][1]), (3001, next(t for i, t in rows if i == 107)), (1, "x " + next(t for i, t in rows if i == 107))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/a/documents.parquet")
    got = sorted((tuple(r) for r in S.query(spark, f"{tmp_path}/a").collect()), key=str)
    assert got == brute(rows) and max(r[2] for r in got) == 6000
    fixtures.empty(spark).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert S.query(spark, f"{tmp_path}/b").collect() == []
