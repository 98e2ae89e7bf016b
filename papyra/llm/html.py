"""Main text of HTML pages by two-pass block rules.

A tolerant tag scan cuts a page into blocks of text. Pass one decides each block by
the elements around it, its link density, its length and its share of stop words:
good, bad, or ambiguous (short, or nearly good). In pass two ambiguous blocks inherit
the label of the nearest decided neighbours; where these differ, a nearly good block
is kept and a short one goes with the nearer.

Both passes decide every block that no excluded element holds; no label is overruled. Standing
in an article or main element is one bounded term of pass one: it adds ARTICLE to the share of
stop words and to the share of links that a block may have. So in an article a block of few stop
words is ambiguous at least, one of mostly links is rejected. A paragraph that is a link from end
to end is ambiguous if it stands in no list and not beside links, and if it is in the article or
the page has none and no good block. Ambiguous blocks ask the decided blocks on their own side of the
element's border first; where there are none, those inside ask beyond it and those outside
are rejected as what stands around an article; excluded elements have no
say over blocks inside the article. Where no block of the page is good, the ambiguous ones of
the article are kept, or without an article all ambiguous ones; a page of one block is that block.

Elements with a class, id or role that is made up of words of page furniture and layout alone
are excluded (cookie-banner is, notice-period isn't); inline ones only drop their own words.

Defined cases: null and empty pages, and pages without text, give an empty string; an empty
table gives no rows; unclosed and crossing elements are closed by the elements around them; a
quoted value that is never closed ends at the next ">"; a page that ends within a tag or comment
ends before it; a text without any tag is one block and decided like any other; repeated rows
give equal results; other columns are ignored. A page costs time in proportion to its length.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.common import table

# Frequent function words of some languages.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been but by can could did do for from had has have he her his
    how i if in into is it its just like more most no not of on one only or other our out over she so some such than that
    the their them then there these they this to up was we were what when which who will with would you your
    aber als am auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer es für hat ich ihr
    im ist kann man mit nach nicht noch nur oder sein sich sie sind so um und uns von vor war was wenn werden wie wir wird
    zu zum zur über
    au aux avec ce ces cette comme dans de des du elle en est et été il ils je la le les leur lui mais même ne nous on ou
    par pas plus pour qu que qui sa se ses si son sont sur tout un une vous à
    al como con cuando del desde donde el ella ellos en entre era es esta este está fue ha hay la las le lo los más me muy
    ni no nos o para pero por porque que se ser si sin sobre su sus también todo un una y ya
    che con da dei della di e gli il in la le non per più si sono un una
    de een en het in is niet op te van voor zijn
    ao com da do dos e em na no não o os para por que se um uma
    """.split()
)

# Elements whose text never counts, block elements, and words in class, id or role of page furniture.
DROPPED = frozenset(
    "script style noscript template iframe object embed svg math canvas audio video select option button textarea input form fieldset nav header footer aside menu dialog head title".split()
)
RAW_TEXT = frozenset("script style textarea title iframe noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
FURNITURE = frozenset(
    """
    ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promoted promotion nav navbar navigation menu sidebar
    breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription paywall
    share sharing social related recommended recommendations comments comment commentlist disqus respond replies widget toolbar pagination
    pager login signup search skip banner contentinfo complementary dialog alert alertdialog sitenav siteheader sitefooter
    """.split()
)
# Layout words that stand beside those of page furniture in a class, id or role.
LAYOUT = frozenset(
    """
    area bar block body bottom box btn button buttons col column container content feed form group head inner item items left link links list main
    message outer page panel post posts region right row section site slot text thread title top unit wrap wrapper
    """.split()
)
# Elements within a line of text, and those that end an open element of their kind.
PHRASES = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",)}
KEEPERS = frozenset(("html", "body", "main", "article"))
MAIN = frozenset(("main", "article"))

LINKS = 0.2
ARTICLE = 0.3
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.30, 0.32

_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/>]|$)""", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PART = re.compile(r"[a-z]+")
_WORD = re.compile(r"\w+")
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW_TEXT}
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class _Zone:
    """An element whose text is left out, unless the article turns out to stand in it."""

    __slots__ = ("around", "holds_main", "out", "sure")

    def __init__(self, sure: bool, around: _Zone | None):
        self.around, self.holds_main, self.sure, self.out = around, False, sure, False


class Block:
    __slots__ = ("heading", "item", "linked", "main", "text", "zone")

    def __init__(self, text: str, linked: int, heading: bool, item: bool, zone: _Zone | None, main: bool):
        self.text, self.linked, self.heading, self.item, self.zone, self.main = text, linked, heading, item, zone, main

    def excluded(self) -> bool:
        return self.zone is not None and self.zone.out


def _is_furniture(name: str) -> bool:
    """Whether a class, id or role says page furniture and nothing else: cookie-banner does, notice-period doesn't."""
    own = set(_PART.findall(_CAMEL.sub("-", name).lower()))
    return not own.isdisjoint(FURNITURE) and own <= FURNITURE | LAYOUT


def _furniture(attrs: str) -> tuple[bool, bool]:
    """(hidden, named as page furniture)"""
    hidden = named = False
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDING.search(value.lower()):
            hidden = True
        elif key in ("class", "id", "role"):
            named = named or any(map(_is_furniture, value.split()))
    return hidden, named


class _Page:
    """Open elements and the text of the block now being read. Every step costs what it opens or closes."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.zones: list[_Zone] = []
        self.stack: list[tuple[str, _Zone | None, bool]] = []
        self.open: dict[str, list[int]] = {}  # places of open elements by name
        self.solid: list[int] = []  # places of open block elements
        self.hard: list[int] = []  # the same without paragraphs
        self.mains = 0
        self.text: list[str] = []
        self.linked: list[str] = []
        self.mute = 0  # open inline elements that are hidden or furniture
        self.heading = False

    def zone(self) -> _Zone | None:
        return self.stack[-1][1] if self.stack else None

    def last(self, *names: str) -> int:
        """The place of the innermost open element of these names, or -1."""
        return max((self.open[n][-1] for n in names if self.open.get(n)), default=-1)

    def push(self, name: str, zone: _Zone | None, mute: bool) -> None:
        at = len(self.stack)
        self.stack.append((name, zone, mute))
        self.mute += mute
        self.open.setdefault(name, []).append(at)
        if name in BLOCKS:
            self.solid.append(at)
            if name != "p":
                self.hard.append(at)
        self.mains += name in MAIN

    def pop_to(self, at: int) -> None:
        while len(self.stack) > at:
            name, _, mute = self.stack.pop()
            self.open[name].pop()
            self.mute -= mute
            self.mains -= name in MAIN
            for places in (self.solid, self.hard):
                if places and places[-1] == len(self.stack):
                    places.pop()

    def say(self, s: str) -> None:
        if s and not self.mute:
            s = _html.unescape(s)
            self.text.append(s)
            if self.open.get("a"):
                self.linked.append(s)

    def flush(self) -> None:
        if self.text:
            whole = " ".join("".join(self.text).split())
            if whole:
                n = len(" ".join("".join(self.linked).split())) if self.linked else 0
                item = bool(self.open.get("li") or self.open.get("td"))
                self.blocks.append(Block(whole, n, self.heading, item, self.zone(), self.mains > 0))
            self.text.clear()
            self.linked.clear()
        self.heading = False

    def close(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
        at = self.last(name)
        # an inline end doesn't close the block around it
        if at >= 0 and (name in BLOCKS or at > (self.solid[-1] if self.solid else -1)):
            self.pop_to(at)

    def start(self, name: str, attrs: str) -> None:
        block = name in BLOCKS
        if block:
            self.flush()
            # an open element of the kind ends here, unless a container stands between; so does a paragraph
            wall = self.hard[-1] if self.hard else 0
            ending = [at for at in (self.last(*SIBLINGS.get(name, ())), self.last("p")) if at >= wall]
            if ending:
                self.pop_to(min(ending))
            self.heading = len(name) == 2 and name[0] == "h" and name[1] in "123456"
        elif name == "a" and self.last("a") > (self.solid[-1] if self.solid else -1):
            self.pop_to(self.last("a"))
        if name in VOID:
            return
        around, inside, zone, mute = self.zone(), self.mains > 0, None, False
        hidden, named = _furniture(attrs) if attrs.strip(" /\n") else (False, False)
        if name == "header" and inside:
            zone = _Zone(True, around) if hidden else None  # the head of the article itself
        elif name in DROPPED:
            zone = _Zone(name not in ("header", "form", "aside", "nav", "footer"), around)
        elif name in KEEPERS:
            if named and name == "article":
                zone = _Zone(True, around)
        elif name in PHRASES:
            mute = hidden or named and not (self.open.get("pre") or self.open.get("code"))
        elif hidden or named:
            zone = _Zone(hidden, around)
        if zone:
            self.zones.append(zone)
        elif name in MAIN and not inside:
            z = around
            while z and not z.holds_main:
                z.holds_main, z = True, z.around
        if block or not attrs.endswith("/"):
            self.push(name, zone or around, mute)


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, white space folded, character references decoded.

    One pass: tags end at ">" outside of quoted values (at the first one if a quote is
    never closed); comments, declarations and tags without an end reach to the page's end.
    """
    p, n, pos = _Page(), len(page), 0
    quotes = {q: page.rfind(q) for q in "\"'"}

    def tag_end(at: int) -> int:
        """Place of the ">" that ends a tag whose attributes begin here, or n."""
        while at < n:
            m = _STOP.search(page, at)
            if not m:
                return n
            at = m.start()
            if page[at] == ">":
                return at
            before = at - 1
            while page[before].isspace():
                before -= 1
            if page[before] != "=":  # a quote within a name
                at += 1
            elif quotes[page[at]] == at:
                end = page.find(">", at)
                return n if end < 0 else end
            else:
                at = page.find(page[at], at + 1) + 1
        return n

    while pos < n:
        at = page.find("<", pos)
        if at < 0:
            p.say(page[pos:])
            break
        kind = page[at + 1 : at + 2]
        m = _NAME.match(page, at)
        if not m and kind not in ("!", "?", "/"):
            p.say(page[pos : at + 1])  # a "<" that begins no tag
            pos = at + 1
            continue
        p.say(page[pos:at])
        if not m:
            if page.startswith("<!--", at):
                end, skip = page.find("-->", at + 4), 3
            elif page.startswith("<![CDATA[", at):
                end, skip = page.find("]]>", at), 3
                p.say(_html.escape(page[at + 9 : n if end < 0 else end]))
            else:
                end, skip = page.find(">", at), 1
            pos = n if end < 0 else end + skip
            continue
        end = tag_end(m.end())
        if end == n:
            break  # the page ends within a tag
        name, pos = m[1].lower(), end + 1
        if name in ("br", "img"):
            p.text.append(" ")
        elif kind == "/":
            p.close(name)
        elif name in RAW_TEXT:
            if name in BLOCKS:
                p.flush()
            close = _CLOSE[name].search(page, pos)
            pos = close.end() if close else n
        else:
            p.start(name, page[m.end() : end])
    p.flush()
    for z in p.zones:  # those around come first
        z.out = z.sure or not z.holds_main or z.around is not None and z.around.out
    return p.blocks


def _lone_link(found: list[Block], i: int) -> bool:
    """A paragraph that is one link from end to end, not one of a list of links."""
    linkish = lambda j: 0 <= j < len(found) and found[j].main == found[i].main and found[j].linked > (LINKS + ARTICLE) * len(found[j].text)
    return found[i].linked == len(found[i].text) and not found[i].item and not linkish(i - 1) and not linkish(i + 1)


def judge(found: list[Block], i: int, poor: bool = False) -> str:
    """The label of pass one: good, bad, near (nearly good) or short. poor: the page has no article, and nothing good."""
    b, size = found[i], len(found[i].text)
    if b.text[0] == "©":
        return "bad"
    term, links = ARTICLE if b.main else 0.0, b.linked / size
    if links > LINKS + term or not term and links > 0 and size < SHORT:
        return ("short" if size < SHORT else "near") if (b.main or poor) and _lone_link(found, i) else "bad"
    if size < SHORT:
        return "short"
    words = _WORD.findall(b.text.lower())
    stop = sum(w in STOP_WORDS for w in words) / max(1, len(words)) + term
    if stop >= STOP_HIGH:
        return "good" if size > LONG else "near"
    return "near" if stop >= STOP_LOW else "bad"


def _nearest(decided: list[str | None]) -> list[tuple[tuple[str | None, int], tuple[str | None, int]]]:
    """For each place the label and distance of the nearest decided place before it and after it."""
    none = (None, len(decided) + 1)
    before, after = [none] * len(decided), [none] * len(decided)
    for out, places in ((before, range(len(decided))), (after, range(len(decided) - 1, -1, -1))):
        last = None
        for i in places:
            if last is not None:
                out[i] = (decided[last], abs(i - last))
            if decided[i]:
                last = i
    return list(zip(before, after))


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    out = [b.excluded() for b in found]
    article = any(b.main and not o for b, o in zip(found, out))
    if len(found) == 1 and not out[0] and found[0].text[0] != "©":
        return found[0].text
    labels = ["bad" if x else judge(found, i) for i, x in enumerate(out)]
    if not article and "good" not in labels:
        labels = ["bad" if x else judge(found, i, True) for i, x in enumerate(out)]
    decided = [x if x in ("good", "bad") else None for x in labels]
    inside = _nearest([x if b.main and not o else None for x, b, o in zip(decided, found, out)])
    outside = _nearest([None if b.main else x for x, b in zip(decided, found)])
    shown = _nearest([None if o else x for x, o in zip(decided, out)])
    final = list(labels)
    some_good = "good" in labels
    for i, x in enumerate(labels):
        if x in ("short", "near"):
            near = inside[i] if found[i].main else outside[i]
            if not any(s for s, _ in near):
                near = shown[i] if found[i].main or not article else (("bad", 1), ("bad", 1))
            (before, d1), (after, d2) = near
            sides = {s for s in (before, after) if s}
            if not sides:
                final[i] = "good"
            elif len(sides) == 1:
                final[i] = sides.pop()
            elif x == "near":
                final[i] = "good"
            else:
                final[i] = before if d1 < d2 else after if d2 < d1 else "bad"
            if x == "short" and found[i].heading and after == "good":
                final[i] = "good"
            if not some_good and (x == "near" or found[i].main or not article):
                final[i] = "good"  # nothing better on the page
    return "\n\n".join(b.text for b, x in zip(found, final) if x == "good")


def _extract(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(x) for x in pages.to_pylist()], pa.string())


_extract.__annotations__ = {"pages": pa.Array, "return": pa.Array}


def extract(html):
    """Column of the main text of a column of HTML."""
    return F.arrow_udf(_extract, "string")(html)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", extract(F.col("html")).alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
