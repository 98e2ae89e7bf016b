"""Small tables with every odd case: nulls, empty and long texts, ties, repeats, clashing extra columns."""

from __future__ import annotations

import random

WORDS = {
    "en": "the of and to in that is was he for it with as his on be at by had not but from they she which or we an were".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass".split(),
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, key string, score string, y string, th string"


def sentence(rng: random.Random, lang: str, n: int) -> str:
    own = WORDS[lang]
    return " ".join(rng.choice(own) + rng.choice(["", "", rng.choice("aeiou") + rng.choice("nrst")]) for _ in range(n))


def documents(n: int = 60, seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        rows.append((i, sentence(rng, lang, rng.randint(5, 120)), lang))
    rows += [(100, None, "en"), (101, "", "de"), (102, "  \n\t ", None), (103, "x", "en"), (104, "12 34 !!", None), (105, rows[0][1], "en"), (106, rows[0][1], "en")]
    rows += [(107, sentence(rng, "en", 6000), "en"), (None, "no id the of and to", "en"), (108, "twice the same row of it", "en"), (108, "twice the same row of it", "en")]
    rows += [(109, rows[3][1] + " end", rows[3][2]), (110, "É <|endoftext|> mixed space ß日本 'll", "en")]
    return [(i, t, lang, "s", len(t or ""), "c", "c", "c", "c", "c") for i, t, lang in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
