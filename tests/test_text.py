"""Text functions."""

from pyspark.sql import functions as F

from papyra.functions import text as T


def one(spark, expr, **values):
    cols = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], cols).select(expr).first()[0]


def test_tokens(spark):
    assert one(spark, T.raw_tokens(F.col("t")), t="Hello, K8s-node a v1.2 ./x naïve") == ["hello", "k8s-node", "v1.2", "./x", "na", "ve"]
    assert one(spark, T.raw_tokens(F.col("t")), t=None) == []


def test_stems(spark):
    pairs = {
        "running": "running", "deploying": "deploying", "hinges": "h", "famous": "famou", "business": "busines", "kubernetes": "kubernet", "status": "statu", "redis": "redi",
        "process": "proces", "classes": "class", "queries": "query", "authentication": "authenticat", "deployment": "deploy", "active": "act", "basically": "basic",
        "tokens.": "tokens.", "api": "api", "studied": "study",
    }
    got = spark.createDataFrame([(list(pairs),)], "t array<string>").select(T.stems(F.col("t"))).first()[0]
    assert got == list(pairs.values())


def test_summaries(spark):
    s = lambda x: one(spark, T.first_sentence(F.col("t")), t=x)
    assert s("First one. Second.") == "First one."
    assert s("[code:py] x = 1\n\nThen text here! More") == "Then text here!"
    assert s("- item first\n- second") == "item first\n- second"
    long = "word " * 60
    assert s(long).endswith("…") and len(s(long)) <= 201 and s("") == ""


def test_titles_and_paths(spark):
    t = lambda a, b: one(spark, T.better_title(F.col("a"), F.col("b")), a=a, b=b)
    assert t("Overview", "docs/api-v2/index.md") == "Api V2 — Overview" and t("Overview", "index.md") == "Overview" and t("Intro", "a/b.md") == "Intro"
    k = lambda p: one(spark, T.type_of_path(F.col("p")), p=p)
    assert [k(p) for p in ("a/Runbooks/x.md", "guide/x.md", "x/howto/y.md", "x/how-to/y.md", "guide.md", "deployments/a.md")] == ["runbook", "guide", "howto", None, None, "deployment"]
    n = lambda p: one(spark, T.normal_path(F.col("p")), p=p)
    assert n("a/b/../c/./d.md") == "a/c/d.md" and n("../x.md") == "x.md"
    assert one(spark, T.slug(F.col("t")), t="Hello, World! 2") == "hello-world-2" and one(spark, T.slug(F.col("t")), t="!!") == "untitled"
    assert one(spark, T.title_of_topic(F.col("t")), t="k8s_node-pools guide") == "K8s Node Pools Guide"


def test_snippet_matches_a_loop(spark):
    import random

    rng = random.Random(1)
    rows = []
    for i in range(150):
        words = [rng.choice(["alpha", "be", "gammas", "d" * rng.randint(1, 30)]) for _ in range(rng.randint(0, 90))]
        rows.append((i, " ".join(words), sorted(rng.randint(0, 110) for _ in range(rng.randint(0, 8)))))
    df = spark.createDataFrame(rows, "i int, c string, p array<int>")
    got = {r[0]: r[1] for r in df.select("i", T.snippet(F.col("c"), F.col("p"), F.lit("the title"))).collect()}

    def cut(s):
        return s if len(s) <= 180 else s[:180] + "…"

    for i, c, p in rows:
        if not c or not p:
            want = cut(c or "the title")
        else:
            ws = c.split()
            v = [x for x in p if x < len(ws)]
            if not v:
                want = cut(c)
            else:
                starts = range(max(0, len(ws) - 30) + 1)
                best = max(starts, key=lambda s: (sum(s <= x < s + 30 for x in v), -s))
                t = " ".join(ws[best : best + 30])
                if len(t) > 180:
                    t = t[:180]
                    k = t.rfind(" ")
                    t = t[:k] if k > 126 else t
                want = ("…" if best else "") + t + ("…" if best + 30 < len(ws) else "")
        assert got[i] == want
