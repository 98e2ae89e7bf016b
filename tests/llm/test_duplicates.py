"""SimHash, components, MinHash against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from papyra.llm import common, minhash, simhash
from papyra.llm import components as hubs
from papyra.llm.components import components
from tests.llm.fixtures import documents, empty, frame


def brute_simhash(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def unions(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("edges, share", [(250_000, 1000), (1, 1000), (1, 20)])
def test_components_of_paths_stars_and_repeats(spark, edges, share, monkeypatch):
    monkeypatch.setattr(hubs, "EDGES_A_FILE", edges)
    monkeypatch.setattr(common, "SHARE", share)
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(7, 7), (1, 0), (0, 1)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    ids = {x for p in pairs for x in p}
    want = unions(ids, pairs)
    assert all(want[n] == c for n, c in got.items()) and {n for p in pairs if p[0] != p[1] for n in p} == set(got)


@pytest.mark.parametrize("share", [1, 3, 10**6])
def test_hot_keys_join_like_others(spark, share, monkeypatch):
    monkeypatch.setattr(common, "SHARE", share)
    keys = [1] * 30 + [2] * 5 + [3, 4, None]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    keyed = spark.createDataFrame([(k, keys.count(k), f"v{k}") for k in (1, 2, 3)], "k long, n long, v string")
    got = sorted(map(tuple, common.beside_hot(rows, keyed, "k", len(keys)).select("k", "i", "v").collect()))
    assert got == [(k, i, f"v{k}") for i, k in enumerate(keys) if k in (1, 2, 3)]


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(9)
    rows = [(r[0], r[1]) for r in documents()]
    base = [t for _, t in rows if t and len(t) > 300]
    for k in range(80):
        words = rng.choice(base[:4]).split()
        words[rng.randrange(len(words))] = f"w{k}"
        rows.append((1000 + k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    fp = {}
    for i, t in rows:
        fp.setdefault(i, brute_simhash(t))
    ids = [i for i in fp if i is not None]
    want = unions(ids, [(a, b) for a in ids for b in ids if a < b and bin(fp[a] ^ fp[b]).count("1") <= 4])
    for block in (8192, 6):
        got = simhash.near_duplicates(df, block=block).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["fp"] % (1 << 64) == fp[r["doc_id"]]
            if r["doc_id"] is not None:
                assert r["component_id"] == want[r["doc_id"]]
    assert simhash.near_duplicates(empty(spark).select("doc_id", "text")).count() == 0


def test_rows_without_an_id_join_others(spark):
    """a ~ b ~ c, and only b has no doc_id."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(400)}" for _ in range(900)]
    rows, prints = [], []
    for k in range(200):
        own = list(words)
        own[rng.randrange(900)] = "x"
        own[rng.randrange(900)] = "y"
        rows.append(" ".join(own))
        prints.append(brute_simhash(rows[-1]))
    apart = lambda i, j: bin(prints[i] ^ prints[j]).count("1")
    a, b, c = next((i, j, k) for j in range(200) for i in range(200) for k in range(200) if apart(i, j) <= 4 and apart(j, k) <= 4 and apart(i, k) > 4)
    df = spark.createDataFrame([(1, rows[a]), (None, rows[b]), (3, rows[c]), (None, "alone here in its group")], "doc_id long, text string")
    got = simhash.near_duplicates(df).collect()
    assert {r["component_id"] for r in got if r["doc_id"]} == {1} and sorted(str(r["component_id"]) for r in got if r["doc_id"] is None) == ["1", "None"]


def test_xxh64_matches_the_library():
    rng = random.Random(5)
    data = bytes(rng.randrange(256) for _ in range(30_000))
    starts = np.array([rng.randrange(15_000) for _ in range(2000)])
    ends = starts + np.array([rng.randrange(140) if k % 20 else rng.randrange(9000) for k in range(2000)])
    got = simhash.xxh64(np.frombuffer(data, np.uint8), starts, ends)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(data[i:j], 42) for i, j in zip(starts, ends)]


def test_fingerprints_of_odd_texts(monkeypatch):
    texts = ["a\x00b c\x00 \x0bD é\u2003f g", "ÀÉ a" + " B" * 700, "w" * 9000 + " x y z " + "v" * 40, None, "", " \t", "one", "one two three", "one two three four", " A\r\nb  c d e "] * 3
    for size in (1, 50, 1 << 20):
        monkeypatch.setattr(simhash, "GROUP", size)
        got = simhash._fingerprints(pa.array(texts)).to_pylist()
        assert [x % (1 << 64) for x in got] == [brute_simhash(t) for t in texts]


def test_links_lose_nothing_in_dense_groups(spark):
    rng = np.random.default_rng(4)
    core = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fps = {int(c) for c in core}
    for c in core:
        for _ in range(120):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(1, 7)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(i, int(np.array(f, np.uint64).view(np.int64))) for i, f in enumerate(fps)], "rep long, fp long")
    want = unions(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    for block in (8192, 20):
        found = [(r["a"], r["b"]) for r in simhash.links(df, block).collect()]
        assert all(bin(fps[a] ^ fps[b]).count("1") <= 4 for a, b in found)
        assert unions(range(len(fps)), found) == want


def words5(t):
    w = re.findall(rb"[a-z0-9\x80-\xff]+", t.encode().lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = words5(a), words5(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_match_brute_force(spark):
    rows = [(r[0], r[1] or "") for r in documents()]
    for buckets in (1, 5):
        got = minhash.fingerprints(frame(spark), buckets).collect()
        assert len(got) == len(rows)
        order = sorted(rows, key=lambda r: (-(1 << 62) if r[0] is None else r[0], r[1]))
        by = {}
        for r in got:
            by.setdefault(r["doc_id"], []).append(r)
        errors = []
        for k, (i, t) in enumerate(order):
            before = order[k - 1][1]
            third = len(t) // 3
            edited = t[: len(t) - third] + before[:third]
            own = [r for r in by[i] if r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()]
            assert own and own[0]["n_chars"] == len(t)
            errors += [own[0]["near_edited"] - jaccard(t, edited), own[0]["near_next"] - jaccard(t, before)]
        assert abs(np.mean(errors)) < 0.01 and np.mean(np.abs(errors)) < 0.03
    same = {}
    for r in got:
        text = dict(order).get(r["doc_id"])
        same.setdefault(text, set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in same.values())


def brute_lanes(text):
    """Low bits of each bin, straight from the definition."""
    def mixed(h):
        h &= M
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & M
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & M
        return h ^ h >> 31

    M, step = (1 << 64) - 1, 0x9E3779B97F4A7C15
    word = lambda w: mixed(sum(c * pow(step, i, 1 << 64) for i, c in enumerate(w)))
    bins = {}
    for gram in words5(text):
        h = len(gram)
        for w in gram:
            h = (h * step + word(w)) & M
        h = mixed(h)
        bins[h >> 55] = min(bins.get(h >> 55, M), h)
    out = []
    for j in range(512 if bins else 0):
        t, at = 0, j
        while at not in bins:
            t += 1
            at = mixed(j * 1_000_003 + t * step) >> 55
        out.append(bins[at] & 15)
    return out or [0] * 512


def test_packed_fingerprints_match_brute_force():
    texts = [r[1] or "" for r in documents()][:75] + ["a b c d", "a", "A-b", "é ß x y z w"]
    got = minhash.lanes(pa.array(texts))
    packed = minhash.pack(got)
    for i, t in enumerate(texts):
        want = brute_lanes(t)
        assert got[i].tolist() == want
        assert packed[i] == "".join(f"{want[k] | want[k + 1] << 4:02x}" for k in range(0, 512, 2))


def test_fingerprints_of_few_rows(spark):
    one = spark.createDataFrame([(5, "a b c d e f")], "doc_id long, text string")
    r = minhash.fingerprints(one).collect()
    assert len(r) == 1 and r[0]["near_next"] == 1.0
    assert minhash.fingerprints(empty(spark)).count() == 0
    x = minhash.lanes(pa.array(["", None, "   ", "word"]))
    assert (x[0] == x[1]).all() and (x[0] == x[2]).all() and not (x[0] == x[3]).all()
