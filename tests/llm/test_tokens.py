"""Tokens, token files and packing against the tokenizer and brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from papyra.llm import packing, tokenfile, tokens
from papyra.session import scratch_path, write_table
from tests.llm.fixtures import documents, empty, frame

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_give_the_tokenizers_ids(path):
    rng = random.Random(3)
    letters = list("abXY019 ,.;'!?<>|-_\n\t\r  　é́ßñ—日ǅİς") + ["'s", "'ll", " the", "  ", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(1500)] + [r[1] for r in documents()]
    plain = Tokenizer.from_file(path)
    e = tokens.Encoder(path, cache=200)
    for _ in range(2):
        k = 0
        for _, ids, sizes in e.groups(pa.array(texts)):
            for n, end in zip(sizes, np.cumsum(sizes)):
                assert ids[end - n : end].tolist() == plain.encode(texts[k] or "", add_special_tokens=False).ids
                k += 1
    assert len(e.known) <= 200


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70000), st.integers(0, 2**32 - 1)), max_size=200))
def test_ranks_round_trip(ranks):
    r = np.array(ranks, np.uint32)
    assert tokenfile.decode_ranks(*tokenfile.encode_ranks(r), len(r)).tolist() == ranks


def test_files_hold_all_documents_in_order(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 500)
    manifest = tokenfile.write_tokens(frame(spark), scratch_path(spark, "t"), WORD)
    got = sorted(tokenfile.read_tokens(manifest).collect(), key=lambda r: r["start"])
    want = sorted(((r[0], r[1] or "") for r in documents()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    plain, start = Tokenizer.from_file(WORD), 0
    assert len(got) == len(want)
    for g, (i, t) in zip(got, want):
        ids = plain.encode(t, add_special_tokens=False).ids + [1]
        assert (g["doc_id"], g["start"], g["n_tokens"]) == (i, start, len(ids))
        assert g["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    none = tokenfile.write_tokens(empty(spark), scratch_path(spark, "t"), WORD)
    assert none.count() == 0 and tokenfile.read_tokens(none).count() == 0


def test_ranks_are_those_of_all_documents(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = tokenfile.write_tokens(frame(spark), scratch_path(spark, "t"), WORD)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plain, counts, tables = Tokenizer.from_file(WORD), {}, []
    for _, t, *_ in documents():
        for i in plain.encode(t or "", add_special_tokens=False).ids + [1]:
            counts[i] = counts.get(i, 0) + 1
    want = sorted(counts, key=lambda i: (-counts[i], i))
    for r in manifest.collect():
        with pa.fs.FileSystem.from_uri(r["path"])[0].open_input_stream(r["path"].removeprefix("file://")) as f:
            while head := f.read(tokenfile.HEADER.size):
                _, docs, _, ranks, nc, nd = tokenfile.HEADER.unpack(head)
                tables.append(np.frombuffer(f.read(4 * ranks), "<u4").tolist())
                f.read(17 * docs + nc + nd)
    assert len(tables) > 3 and all(t == want[: len(t)] for t in tables) and max(map(len, tables)) == len(want)


def check_sequences(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_pieces_of_documents(spark):
    got = packing.pack_documents(frame(spark)).collect()
    check_sequences(got, packing.SEQUENCE)
    plain = Tokenizer.from_file(BYTE)
    left = {}
    for r in got:
        left.setdefault((r["doc_id"], r["piece"]), []).append(r)
    for i, t in {(r[0], r[1] or "") for r in documents()}:
        ids, pos, k = plain.encode(t, add_special_tokens=False).ids + [packing.END], 0, 0
        while pos < len(ids):
            p = left[i, k][0]
            assert p["start"] == pos and p["ids_crc32"] == zlib.crc32(np.array(ids[pos : pos + p["length"]], "<u4").tobytes())
            assert k == 0 or p["length"] == packing.SEQUENCE
            pos, k = pos + p["length"], k + 1
        assert (i, k) not in left and (len(ids) > packing.SEQUENCE or k == 1)
    assert len(left[108, 0]) == 2
    assert packing.pack_documents(empty(spark)).count() == 0


def test_tree_of_rounds_packs_close_to_the_bound(spark):
    rng = np.random.default_rng(1)
    sizes = np.concatenate([rng.integers(1, 1024, 1500), np.full(300, 600), np.full(20, 1024)])
    df = write_table(
        spark.createDataFrame([(i, 0, 0, int(s), i) for i, s in enumerate(sizes)], packing.PIECES).repartition(4), "pieces"
    )
    for items in (50_000, 100):
        rows = packing.pack(df, items=items).collect()
        assert sorted(r["doc_id"] for r in rows) == list(range(len(sizes)))
        n = check_sequences(rows, 1024)
        bound = max(-(-int(sizes.sum()) // 1024), int((sizes > 512).sum()))  # no two longer ones share a sequence
        assert n <= bound * (1.02 if items > 1000 else 1.05)


def test_best_fit_takes_the_fullest_bin_that_holds():
    assert packing.best_fit(np.array([6, 5, 4, 3, 2]), 10) == [[0, 2], [1, 3, 4]]
    assert packing.best_fit(np.zeros(0, np.int64), 10) == []


def test_the_tokenizer_is_given_few_pieces_at_once(monkeypatch):
    """Of many new words it returns objects of a kilobyte each; the ids stay those of one call."""
    words = [f"w{k:05d}x" for k in range(tokens.PLAIN + 100)]
    enc, calls = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json")), []

    class Spy:
        def encode_batch_fast(self, texts, **how):
            calls.append(len(texts))
            return real.encode_batch_fast(texts, **how)

    real, enc.tok = enc.tok, Spy()
    got = enc._plain(words)
    assert max(calls) <= tokens.PLAIN and got == [e.ids for e in real.encode_batch_fast(words, add_special_tokens=False)]
