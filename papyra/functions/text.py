"""Text functions as column expressions (JVM-side, no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters a token may have, and the suffix rules of the stemmer in their order.
TOKEN_LETTERS = r"[a-z0-9_\-./]"
DROPPED_SUFFIXES = ("ment", "ness", "able", "ible", "ally", "ful", "ous", "ive", "ly")
#: All of them in one pass: what the rules take from a word's end one after another stands there in the opposite order.
_DROPPED = "(?=[a-z])" + "".join(f"(?:{s})?+" for s in reversed(DROPPED_SUFFIXES))


def raw_tokens(text: Column, least: int = 2) -> Column:
    """Lower-cased tokens of at least this length; null gives an empty array. One pass: a token is a run of its letters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"{TOKEN_LETTERS}{{{least},}}+"), F.lit(0))


def grams(text: Column) -> Column:
    """Distinct runs of up to three characters that stand in a text, the empty one included: what begins any of its substrings."""
    runs = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in (1, 2, 3)]
    return F.array_distinct(F.concat(F.array(F.lit("")), *runs))


def stems(tokens: Column) -> Column:
    """Light suffix stripping of an array of tokens as raw_tokens gives them; tokens under four letters stay.

    The tokens are joined, each rule is one replacement at the ends of all words, and what
    comes out is split again. `ing` goes only where two letters more went before it, which
    `es` alone leaves possible.
    """
    c = F.array_join(tokens, " ")
    for pattern, put in (("ie[sd]", "y"), ("(?:ing)?es|s", ""), ("tion", "t"), (_DROPPED, "")):
        c = F.regexp_replace(c, f"(?:{pattern})(?![^ ])", put)
    return F.zip_with(tokens, F.slice(F.split(c, " "), 1, F.size(tokens)), lambda t, s: F.when(F.length(t) < 4, t).otherwise(s))


def code_tokens(content: Column) -> Column:
    """Distinct tokens of the `[code:lang] ...` regions, each up to the next one, a blank line or the end."""
    regions = F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(r"(?s)\[code:\w*\]\s*(.*?)(?=\[code:|\n\n|\z)"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(regions, lambda r: raw_tokens(r))))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != ""))


def _remove_first(text: Column, pattern: str) -> Column:
    """Remove the first match only; the rest of the text follows it unchanged."""
    return F.regexp_replace(text, rf"(?s)\A(.*?)(?m:{pattern})(.*)\z", "$1$2")


def first_sentence(content: Column) -> Column:
    """Up to 200 characters: the first sentence, or a cut at a blank with an ellipsis."""
    body = F.coalesce(content, F.lit(""))
    clean = F.trim(_remove_first(_remove_first(body, r"^\[code:\w*\][^\n]*$"), r"^[-*+]\s+"))
    clean = F.regexp_replace(clean, r"\A\s+|\s+\z", "")
    stop = F.regexp_instr(clean, F.lit(r"[.!?](\s|\z)"))
    head = F.left(clean, F.lit(200))
    space = F.length(head) - F.locate(" ", F.reverse(head))
    return (
        F.when(clean == "", F.left(body, F.lit(200)))
        .when((stop > 0) & (stop <= 200), F.left(clean, stop))
        .when(F.length(clean) <= 200, clean)
        .when(F.contains(head, F.lit(" ")) & (space > 120), F.concat(F.left(head, space), F.lit("…")))
        .otherwise(F.concat(head, F.lit("…")))
    )


def strip_html(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), r"\A\s+|\s+\z", "")


def slug(text: Column) -> Column:
    """Letters and digits joined by hyphens, at most 60 characters, or `untitled`."""
    s = F.left(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(60))
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("untitled")).otherwise(s)


def capitalised(words: Column) -> Column:
    """Words with their first letter upper case, the rest unchanged."""
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 20))), " ")


def title_of_topic(topic: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(topic, "[-_]+", " "), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > 0, capitalised(words)).otherwise(F.lit("Untitled"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


#: Titles that say nothing without their folder.
GENERIC_TITLES = ("introduction", "index", "overview", "readme", "getting started", "home", "main", "about", "summary")


def better_title(title: Column, path: Column) -> Column:
    """`Parent Folder — Title` for generic titles of files in a folder."""
    folders = F.filter(F.split(F.regexp_replace(path, r"(?i)\.md$", ""), "/"), lambda p: p != "")
    parent = F.regexp_replace(F.get(folders, F.size(folders) - 2), "[-_]", " ")
    letters = F.regexp_extract_all(parent, F.lit(r"(?s)\b\w|."), F.lit(0))
    starts = F.transform(letters, lambda c, i: F.when((i == 0) | ~F.get(letters, F.greatest(i - 1, F.lit(0))).rlike(r"\w"), F.upper(c)).otherwise(c))
    named = F.concat(F.array_join(starts, ""), F.lit(" — "), title)
    return F.when(F.lower(title).isin(*GENERIC_TITLES) & (F.size(folders) >= 2), named).otherwise(title)


#: Patterns of a path's folders and the type they stand for, in order; the first that matches counts.
PATH_TYPES = (
    (r"\brunbooks?\b", "runbook"),
    (r"\bguides?\b", "guide"),
    (r"\btutorials?\b", "tutorial"),
    (r"\breference\b", "reference"),
    (r"\bapi[-_]?docs?\b", "api-reference"),
    (r"\barchitectur(e|al)\b", "architecture"),
    (r"\badrs?\b", "adr"),
    (r"\brfcs?\b", "rfc"),
    (r"\bprocedures?\b", "procedure"),
    (r"\bplaybooks?\b", "playbook"),
    (r"\btroubleshoot", "troubleshooting"),
    (r"\bfaqs?\b", "faq"),
    (r"\bchangelog", "changelog"),
    (r"\brelease[-_]?notes?\b", "release-notes"),
    (r"\bhowto\b", "howto"),
    (r"\bops\b", "operations"),
    (r"\bdeploy", "deployment"),
    (r"\bpipeline", "pipeline"),
    (r"\bonboard", "onboarding"),
    (r"\bpostmortem", "postmortem"),
)


def type_of_path(path: Column) -> Column:
    """Type named by a path's folders, or null."""
    d = directory(path)
    return F.coalesce(*(F.when(d.rlike("(?i)" + p), F.lit(t)) for p, t in PATH_TYPES))


def normal_path(path: Column) -> Column:
    """Collapse `.` and `..`; `..` above the root is dropped."""
    start = F.array().cast("array<string>")
    step = lambda acc, p: F.when(p == ".", acc).when(
        p == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
    ).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")


def snippet(content: Column, positions: Column, title: Column, size: int = 180, per_word: int = 6) -> Column:
    """The densest window of max(10, size / per_word) words around the positions, at most size characters.

    Positions count tokens of title and body, words are split at white space; the two
    scales are compared as they are.
    """
    n_words = max(10, size // per_word)
    text = F.when(F.coalesce(content, F.lit("")) == "", title).otherwise(content)
    head = F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("…"))).otherwise(text)
    # a struct per stage keeps each expression evaluated once: arrays of one element, transformed
    ws = F.split(content, r"\s+")
    box = F.array(F.struct(ws.alias("w"), F.filter(positions, lambda p: (p >= 0) & (p < F.size(ws))).alias("v")))
    box = F.transform(
        box,
        lambda b: F.struct(
            b["w"].alias("w"),
            b["v"].alias("v"),
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(b["w"]) - n_words)),
                lambda s: F.size(F.filter(b["v"], lambda p: (p >= s) & (p < s + n_words))),
            ).alias("c"),
        ),
    )
    box = F.transform(
        box, lambda b: F.struct(b["w"].alias("w"), b["v"].alias("v"), (F.array_position(b["c"], F.array_max(b["c"])).cast("int") - 1).alias("s"))
    )
    box = F.transform(
        box, lambda b: F.struct(b["w"].alias("w"), b["v"].alias("v"), b["s"].alias("s"), F.array_join(F.slice(b["w"], b["s"] + 1, n_words), " ").alias("t"))
    )

    def finish(b: Column) -> Column:
        cut = F.left(b["t"], F.lit(size))
        k = F.length(cut) - F.locate(" ", F.reverse(cut))
        body = F.when(F.length(b["t"]) <= size, b["t"]).when(F.contains(cut, F.lit(" ")) & (k > size * 0.7), F.left(cut, k)).otherwise(cut)
        return F.when(F.size(b["v"]) == 0, head).otherwise(
            F.concat(F.when(b["s"] > 0, "…").otherwise(""), body, F.when(b["s"] + n_words < F.size(b["w"]), "…").otherwise(""))
        )

    whole = F.transform(box, finish)[0]
    return F.when((F.coalesce(content, F.lit("")) == "") | (F.size(positions) == 0), head).otherwise(whole)
