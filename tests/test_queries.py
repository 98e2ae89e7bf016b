"""Every query against its SQL on the smallest data, and the contract's entry points."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from papyra.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def flat(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        number = pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c])
        df[c] = df[c].astype(float).map(lambda x: repr(round(x, 6))) if number else df[c].map(lambda x: "NULL" if x is None or x != x else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_matches_sql(spark, con, name):
    got, want = flat(queries.QUERIES[name](spark, SF).toPandas()), flat(con.sql(queries.SQL[name]).df())
    pd.testing.assert_frame_equal(got, want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_searches_whole_texts(spark, con):
    got = flat(entry.entry(spark).toPandas())
    pd.testing.assert_frame_equal(got, flat(con.sql(queries.SQL["bm25_batch"]).df()))
    assert "list_slice" not in queries.SQL["bm25_batch"].split("qi AS")[1].split("qt0")[0]


def test_code_tokens_of_all_nodes(spark, tmp_path):
    rows = [(1, 0, "user", "plain words"), (1, 1, "bot", "aa bb aa\n\nprose cc"), (1, 2, "user", "see [code:y] p1 p2\n\nend [code:z] p3"), (1, 4, "bot", None), (2, 1, "user", "dd\nee")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["node_id"]: r["n_code"] for r in queries.QUERIES["code_tokens"](spark, str(tmp_path)).collect()}
    want = {}
    for c, t, _, text in rows:
        body = ("[code:x] " if t % 3 == 1 else "") + (text or "")
        parts = [p.split("]", 1)[1].split("\n\n")[0] for p in body.split("[code:")[1:]]
        want[f"conv:{c}:n{t + 1}"] = len({w for p in parts for w in p.split()})
    assert got == want and sorted(got.values()) == [0, 0, 2, 2, 3]
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert dict(c.sql(queries.SQL["code_tokens"]).fetchall()) == want


def test_snippets_of_all_top_rows(spark, tmp_path):
    head = "zz,+" * 8 + "nicht"
    long = "zz,+" * 80 + "nicht"
    rows = [(1, "ab cd nicht ef gh ij kl mn op"), (2, head), (3, long)]
    spark.createDataFrame([(i, t, "de", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["snippet"] for r in queries.QUERIES["snippet_density"](spark, str(tmp_path)).collect()}
    assert got == {"docs:1": rows[0][1], "docs:2": head, "docs:3": long[:180] + "…"}
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {d: t for _, d, t in c.sql(queries.SQL["snippet_density"]).fetchall()} == got
