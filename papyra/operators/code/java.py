"""Java symbols (C09): package and imports, types, members, inner types."""

from __future__ import annotations

import re

from papyra.operators.code.scan import Source

EXTENSIONS = ("java",)

_TYPE = re.compile(r"(?:^|[\s)])(?P<kind>class|interface|enum|record|@interface)\s+(?P<name>\w+)", re.A)
_KINDS = {"class": "class", "record": "class", "interface": "interface", "@interface": "interface", "enum": "enum"}
_CALL = re.compile(r"(?P<before>.*?)(?P<name>\w+)\s*\($", re.A)
_ANNOTATION = re.compile(r"^@(?!interface\b)[\w.]+\s*", re.A)
#: Words before a parenthesis that are no method names.
_CONTROL = frozenset("if for while switch catch return new throw else do try synchronized super this assert case instanceof".split())
MOST = 12


def _code(line: str) -> str:
    return line.split("//")[0].strip()


def _declaration(src: Source, i: int, last: int) -> tuple[str, int]:
    """Code from line i up to the first `{` or `;`, and the line where it stands."""
    parts = []
    for k in range(i, min(i + MOST, last + 1)):
        t = _code(src.lines[k])
        parts.append(t)
        if "{" in t or ";" in t:
            return " ".join(parts), k
    return " ".join(parts), min(i + MOST, last + 1) - 1


def _without_annotations(s: str) -> str:
    while m := _ANNOTATION.match(s):
        s = s[m.end() :]
        if s.startswith("("):
            depth = 0
            for k, c in enumerate(s):
                depth += (c == "(") - (c == ")")
                if depth == 0:
                    s = s[k + 1 :].lstrip()
                    break
            else:
                return ""
    return s


def _method_name(head: str, owner: str) -> str | None:
    """The name a member's head declares, or None."""
    opening = head.find("(")
    if opening < 0 or "=" in head[:opening]:
        return None
    m = _CALL.match(head[: opening + 1])
    if not m or m["name"] in _CONTROL or m["before"].rstrip().endswith("."):
        return None
    words = re.sub(r"<[^<>]*>", " ", re.sub(r"<[^<>]*>", " ", m["before"])).split()
    types = [w for w in words if w not in ("public", "private", "protected", "static", "final", "abstract", "native", "synchronized", "default", "strictfp")]
    if any(w in _CONTROL for w in types):
        return None
    return m["name"] if types or m["name"] == owner else None


def _skip_comment(src: Source, i: int) -> int | None:
    """The line after a block comment that begins on line i."""
    if not src.trimmed[i].startswith("/*"):
        return None
    return next((k for k in range(i, len(src)) if "*/" in src.lines[k]), len(src) - 1) + 1


def _members(src: Source, owner: int, name: str, start: int, end: int) -> None:
    i = src.until(start, "{") + 1
    first = None
    while i < end:
        t = _code(src.lines[i])
        after = _skip_comment(src, i)
        if after is not None or not t or t in "{}":
            i = after or i + 1
            continue
        begin = i if first is None else first
        if t.startswith("@") and not t.startswith("@interface") and not _without_annotations(t):
            first, i = begin, (src.brackets(i) if t.count("(") > t.count(")") else i) + 1
            continue
        head, at = _declaration(src, i, end - 1)
        head = _without_annotations(re.split(r"[{;]", head)[0].strip())
        m = _TYPE.search(" " + head) if "(" not in head.split("class")[0].split("interface")[0] or "record" in head else None
        if m:
            stop = src.braces(i, i, end)
            src.add(_KINDS[m["kind"]], m["name"], begin, stop, "public" in head, head[:400], owner)
        elif found := _method_name(head, name):
            stop = src.statement(i, end - 1)
            src.add("method", found, begin, stop, "public" in head, head[:400], owner)
        else:
            stop = max(src.statement(i, end - 1), at)
        first, i = None, max(stop, i) + 1


def parse(src: Source) -> None:
    n = len(src)
    lines = [k for k, t in enumerate(src.trimmed) if t.startswith(("package ", "import "))]
    if lines:
        src.add("import", "imports", lines[0], lines[-1], signature=src.trimmed[lines[0]])
    i, first = 0, None
    while i < n:
        t = _code(src.lines[i])
        after = _skip_comment(src, i)
        if after is not None or not t or t.startswith(("package ", "import ", "*")):
            i = after or i + 1
            continue
        begin = i if first is None else first
        if t.startswith("@") and not t.startswith("@interface") and not _without_annotations(t):
            first, i = begin, (src.brackets(i) if t.count("(") > t.count(")") else i) + 1
            continue
        head, _ = _declaration(src, i, n - 1)
        head = _without_annotations(head.split("{")[0].strip())
        m = _TYPE.search(" " + head)
        if m:
            stop = src.braces(i, i)
            at = src.add(_KINDS[m["kind"]], m["name"], begin, stop, "public" in head, head[:400])
            _members(src, at, m["name"], i, stop)
            i = stop
        first = None
        i += 1
