"""Searches that want more indexed terms than a batch sends; blocks without postings; the stemmer's passes."""

import itertools

from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.operators import search
from papyra.operators.indexing import Index
from tests.test_blocks import QUERIES, rows, tables


def test_many_wanted_terms_are_scored_by_blocks(spark, monkeypatch):
    """Postings aren't made, and aren't dealt by node."""
    index = Index.build(*tables(spark, 90, 1), auto_glossary=False)
    terms = search.query_terms(index, search.query_frame(spark, QUERIES), expand=False)
    hows = ({}, {"prefix": False}, {"filters": {"kind": "a"}}, {"collection": "two"}, {"bonuses": False})
    with monkeypatch.context() as m:
        m.setattr(search, "_batch", lambda *_: None)
        got = [rows(search.best(index, terms, 7, **how)) for how in hows]
        m.setattr(search.blocks, "read_many", lambda b, w, k, few, read=search.blocks.read_many: read(b, w, k, False))  # dealt by term
        assert rows(search.best(index, terms, 7)) == got[0]
        heavy = index.with_weights(one=2.5)
        weighed = rows(search.best(heavy, terms, 7))
    assert "numbered_postings" not in index.made()
    early = sorted(map(tuple, index.vocab.collect()))
    assert got == [rows(search.top(search.scored(index, terms, **how), 7)) for how in hows]
    assert weighed == rows(search.top(search.scored(heavy, terms), 7))
    assert early == sorted(map(tuple, index.numbered_postings.groupBy("term").agg(F.count("*").alias("df")).collect()))
    less = index.remove(["d1", "d2"])
    want = rows(search.best(less, terms, 7))
    monkeypatch.setattr(search, "_batch", lambda *_: None)
    assert rows(search.best(less, terms, 7)) == want


def test_suffixes_in_one_pass_are_those_of_the_rules_one_by_one(spark):
    ends = ["", *T.DROPPED_SUFFIXES, "tion", "ies", "s", "ingly"]
    words = [h + "".join(e) for h in ("", "x", "al", "run", "ment-", "i.", "a_") for n in (1, 2, 3) for e in itertools.product(ends, repeat=n)]
    words = [w for w in dict.fromkeys(words) if len(w) >= 2]
    c = F.array_join("words", " ")
    for pattern, put in (("ie[sd]", "y"), ("(?:ing)?es|s", ""), ("tion", "t"), *((s, "") for s in T.DROPPED_SUFFIXES)):
        c = F.regexp_replace(c, f"(?:{pattern})(?![^ ])", put)
    want = F.zip_with("words", F.split(c, " "), lambda t, s: F.when(F.length(t) < 4, t).otherwise(s))
    got, one_by_one = spark.createDataFrame([(words,)], "words array<string>").select(T.stems(F.col("words")), want).first()
    assert [w for w, a, b in zip(words, got, one_by_one) if a != b] == []
