"""Chat formatting round trips; block rules on small pages."""

import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from papyra.llm import chat, html

PIECES = st.lists(st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "\\", "[", "<", "a", "é", "\n", "[ROLE]", "<<SYS>>", "\\[", "<\\"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "x[ROLE]"]), PIECES), max_size=5))
def test_formatted_turns_read_back(turns):
    f = chat.Formatter()
    whole = "".join(s for role, text in turns for s, _ in f.segments(role, text))
    assert [(r, t) for r, t, _ in f.parse(whole)] == turns
    for role, text in turns:
        body = f.escape(text)
        assert not any(c in body for c in f.t.controls()) and f.unescape(body) == text


def test_query_matches_brute_force(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>yo"), (2, 1, "assistant", None), (2, 0, None, "x"), (2, 1, "assistant", "a"), (None, 0, "user", "n"), (3, 0, "bot", ""), (3, 0, "bot", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS segments", "2 AS valid")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert set(got) == {1, 2, 3, None}
    for c, r in got.items():
        own = sorted(((t, ro or "", x or "") for k, t, ro, x in rows if k == c))
        want = "".join(f"{ro}\n{x}\n" for _, ro, x in own)
        loss = "".join(x for _, ro, x in own if ro == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(want.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[1]["n_violations"] == 0 and got[2]["n_violations"] == 3 and got[3]["n_violations"] == 2


def test_empty_conversations_give_the_planted_one(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = chat.query(spark, str(tmp_path)).collect()
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in rows] == [(-7, 2, 21)]


def test_article_of_a_page():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=x>Menu</a></nav><div class="cookie-banner">We use cookies</div>
    <article><h1>Head &amp; line</h1><p>One<br>two &nbsp; three<p>Short.<ul><li>item one<li>item two</ul><script>var a="<p>";</script><div class="ad">Buy</div>
    <aside>More</aside><form>Name <input></form><section class="comments"><p>First!</p></section></article><footer>&copy; X</footer></body></html>"""
    assert html.main_text(page) == "Head & line\n\nOne two three\n\nShort.\n\nitem one\n\nitem two"


def test_page_without_an_article_uses_block_rules():
    good = "<p>" + "It is the case that we were in the house and he had been there for a very long time with all of them. " * 3 + "</p>"
    page = f"<div><a href=1>Home</a> <a href=2>News</a></div><div>{good}<p>A short one.</p>{good}</div><div><a href=3>Contact us today</a></div>"
    text = html.main_text(page).split("\n\n")
    assert len(text) == 3 and text[1] == "A short one."


def test_odd_pages(spark):
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p>") == html.main_text("<!-- x") == html.main_text("<script>x") == ""
    assert html.main_text("<article><p>a <b>b<p>c</article>") == "a b\n\nc"
    df = spark.createDataFrame([(1, "u", None), (2, None, "<article>x &lt; y</article>"), (2, None, "<article>x &lt; y</article>")], "page_id long, url string, html string")
    rows = df.select("page_id", html.extract("html").alias("t")).collect()
    assert sorted((r[0], r[1]) for r in rows) == [(1, ""), (2, "x < y"), (2, "x < y")]


def test_an_article_is_one_signal_among_the_block_rules():
    good = "It is the case that we were in the house and he had been there for a very long time with all of them. " * 3
    text = good.strip()
    # the body is in divs, the article is a short box beside links
    page = f"<body><article><p>New offer</p></article><div><a href=1>All offers here</a></div><div>{good}</div></body>"
    assert html.main_text(page) == text
    # rejected text of an article goes with its neighbours in it, not with those beyond its border
    rare = "Zork blap quux frob wibble " * 5
    links = "<a href=1>one link</a> and <a href=2>two links</a> "
    page = f"<body><div>{links}</div><article><p>{good}</p><p>{rare}</p></article><div>{rare}</div><div>{links}</div></body>"
    assert html.main_text(page).split("\n\n") == [text, rare.strip()]
    # links decide in an article too, together with what stands around
    assert html.main_text(f"<article><p>{links}</p><p>x <a href=1>yz</a> zz</p><p>{links}</p></article><div>{good}</div>") == text


def test_markup_never_leaks_and_article_text_stays():
    t = html.main_text
    assert t('<article><p>one and some words <a href="foo>text more</p><p>two</p></article>') == "one and some words text more\n\ntwo"
    assert t('<article><p title="a > b">one</p><p data-x=it\'s>two</p><p>a < b</p></article>') == "one\n\ntwo\n\na < b"
    assert t("<article><p>one</p><p>two <i") == "one\n\ntwo"
    assert t("<article><p>A.</p><p><a>Whole paragraph link.</a></p><p>B.</p></article>") == "A.\n\nWhole paragraph link.\n\nB."
    assert t("<article><p>A.</p><ul><li><a>One</a><li><a>Two</a></ul><p>B.</p></article>") == "A.\n\nB."
    assert t('<article><p class="notice-period">The notice period.</p><div class="cookieBanner">Cookies</div><p id="ad-slot-3">Buy</p></article>') == "The notice period."
    assert t('<article><p>One <span hidden>x</span><b class="ad">Buy</b> two</p><pre><span class="comment"># kept</span></pre></article>') == "One two\n\n# kept"
    assert t("<form><article><p>In a form.</p></article><p>Send</p></form>") == "In a form."


def slow_rule(found, i, poor=False):
    """Pass one for one block, from what the module's docstring says of it."""
    text, n = found[i].text, len(found[i].text)
    inside = found[i].main
    allowed = 0.5 if inside else 0.2
    share = found[i].linked / n
    too_many = share > allowed or (not inside and share > 0 and n < 70)
    if text.startswith("©"):
        return "bad"
    if too_many:
        beside = [found[j] for j in (i - 1, i + 1) if 0 <= j < len(found)]
        links_beside = any(b.main == inside and b.linked / len(b.text) > 0.5 for b in beside)
        alone = found[i].linked == n and not found[i].item and not links_beside
        if not alone or not (inside or poor):
            return "bad"
        return "near" if n >= 70 else "short"
    if n < 70:
        return "short"
    words = re.findall(r"\w+", text.lower())
    frequent = len([w for w in words if w in html.STOP_WORDS]) / (len(words) or 1)
    if inside:
        frequent += 0.3
    if frequent < 0.30:
        return "bad"
    return "good" if frequent >= 0.32 and n > 200 else "near"


def slow_labels(found):
    """Pass one and pass two, block by block, by searching both ways for each."""
    out = [b.excluded() for b in found]
    if len(found) == 1 and not out[0] and found[0].text[0] != "©":
        return ["good"]
    first = ["bad" if x else slow_rule(found, i) for i, x in enumerate(out)]
    if not any(f.main and not o for f, o in zip(found, out)) and not first.count("good"):
        first = ["bad" if x else slow_rule(found, i, True) for i, x in enumerate(out)]

    def nearest(i, step, may):
        j = i + step
        while 0 <= j < len(found):
            if first[j] in ("good", "bad") and may(j):
                return first[j], abs(i - j)
            j += step
        return None, len(found) + 1

    final = []
    article = any(f.main and not o for f, o in zip(found, out))
    for i, x in enumerate(first):
        if x in ("good", "bad"):
            final.append(x)
            continue
        side = (lambda j: found[j].main and not out[j]) if found[i].main else (lambda j: not found[j].main)
        (a, da), (b, db) = nearest(i, -1, side), nearest(i, 1, side)
        if a is None and b is None and not found[i].main and article:
            a = b = "bad"
        if a is None and b is None:
            (a, da), (b, db) = nearest(i, -1, lambda j: not out[j]), nearest(i, 1, lambda j: not out[j])
        if a is None and b is None:
            y = "good"
        elif a is None or b is None or a == b:
            y = a or b
        elif x == "near":
            y = "good"
        else:
            y = a if da < db else b if db < da else "bad"
        if x == "short" and found[i].heading and b == "good" or "good" not in first and (x == "near" or found[i].main or not article):
            y = "good"
        final.append(y)
    return final


GOOD = "It is the case that we were in the house and he had been there for a very long time with all of them. "
BLOCK = st.tuples(
    st.sampled_from(["p", "h2", "div", "li", "td"]), st.sampled_from(["", ' class="ad"', ' class="x-ad"', " hidden"]),
    st.sampled_from(["A word.", GOOD, GOOD * 3, "Zork blap quux frob wibble " * 9, "<a>Link here</a>", "<a>Link</a> and some more words of it", GOOD + "<a>over there</a>", "© 2020", ""]),
)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["", "article", "nav", "main", "div class=sidebar"]), st.lists(BLOCK, max_size=6)), max_size=5))
def test_two_passes_match_brute_force(page):
    whole = "".join(f"<{o or 'div'}>" + "".join(f"<{t}{a}>{x}</{t}>" for t, a, x in inner) + f"</{(o or 'div').split()[0]}>" for o, inner in page)
    found = html.blocks(whole)
    assert html.main_text(whole) == "\n\n".join(b.text for b, x in zip(found, slow_labels(found)) if x == "good")


def test_short_pages_without_an_article_keep_their_text():
    t = html.main_text
    assert t("<p>A.</p><p><a>Whole paragraph link.</a></p><p>B.</p>") == "A.\n\nWhole paragraph link.\n\nB."
    assert t('one <a href="foo>text more') == "one text more"
    assert t("<p>A.</p><ul><li><a>One</a><li><a>Two</a></ul><p>B.</p>") == "A.\n\nB."
    assert t("<p>© 2020 X</p>") == "" and t("Only some words") == "Only some words"


def test_rules_alone_drop_blocks_in_and_around_an_article():
    links = "<a href=1>one link</a> and <a href=2>two links</a> "
    page = f"<div>{links}</div><article><p>{GOOD * 3}</p><p>{links * 5}</p><p>{GOOD * 3}</p></article><div>Zork blap quux frob wibble here and there once more again today ever</div>"
    assert html.main_text(page).split("\n\n") == [(GOOD * 3).strip()] * 2
    found = html.blocks(page)
    assert [html.judge(found, i) for i in range(len(found))] == ["bad", "good", "bad", "good", "short"]


def test_hostile_pages_cost_linear_time():
    n = 100_000
    began = time.process_time()
    assert html.main_text("<i " * n) == ""
    assert html.main_text("<!x " * n) == ""
    assert html.main_text('<a href="' * n + "x") == ""
    assert html.main_text("<div class=ad><p>" * n) == ""
    assert html.main_text("<b>" * n + "</i>" * n + "x") == "x"
    assert html.main_text("<article>" + "<p>word" * n).count("\n\n") == n - 1
    assert html.main_text("<p>" + GOOD * n) == (GOOD * n).strip()
    assert time.process_time() - began < 60


def test_pages_query_on_an_empty_table_and_extra_columns(spark, tmp_path):
    kind = "page_id long, url string, html string, text string, n_chars string"
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/a/pages.parquet")
    assert html.query(spark, f"{tmp_path}/a").collect() == []
    spark.createDataFrame([(1, "u", "<article><p>x</p><p>é</p></article>", "t", "n"), (None, None, None, None, None)], kind).write.parquet(f"{tmp_path}/b/pages.parquet")
    assert sorted(map(tuple, html.query(spark, f"{tmp_path}/b").collect()), key=str) == [(1, "u", "x\n\né", 4), (None, None, "", 0)]
