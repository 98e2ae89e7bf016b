"""Rust symbols (C11): types first, then methods of impl blocks, functions, constants, type aliases."""

from __future__ import annotations

import re

from papyra.operators.code.scan import Source

EXTENSIONS = ("rs",)

_PUB = r"(?P<pub>pub(?:\([^)]*\))?\s+)?"
_TYPE = re.compile(_PUB + r"(?P<kind>struct|enum|trait)\s+(?P<name>\w+)", re.A)
_IMPL = re.compile(r"(?:unsafe\s+)?impl(?:<[^{]*?>)?\s+(?:[\w:<>,'&\s]+?\s+for\s+)?(?P<owner>\w+)", re.A)
_FN = re.compile(_PUB + r"(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\"[^\"]*\"\s+)?fn\s+(?P<name>\w+)", re.A)
_CONST = re.compile(_PUB + r"(?:const|static)\s+(?:mut\s+)?(?P<name>\w+)\s*:", re.A)
_ALIAS = re.compile(_PUB + r"type\s+(?P<name>\w+)", re.A)
_KINDS = {"struct": "class", "enum": "enum", "trait": "interface"}


def parse(src: Source) -> None:
    owners: dict[str, int] = {}
    i = 0
    while i < len(src):
        end = i
        if m := _TYPE.match(src.trimmed[i]):
            end = src.statement(i)
            owners[m["name"]] = src.add(_KINDS[m["kind"]], m["name"], i, end, bool(m["pub"]))
        i = end + 1
    i = 0
    while i < len(src):
        line, end = src.trimmed[i], i
        if line.startswith(("impl", "unsafe impl")) and (m := _IMPL.match(line)):
            end, k = src.braces(i), i + 1
            while k < end:
                if f := _FN.match(src.trimmed[k]):
                    stop = min(src.statement(k, end - 1), end)
                    src.add("method", f["name"], k, stop, bool(f["pub"]), src.joined(k, 6, "{;"), owners.get(m["owner"]))
                    k = max(stop, k)
                k += 1
        elif m := _TYPE.match(line):
            end = src.statement(i)
        elif m := _FN.match(line):
            end = src.statement(i)
            src.add("function", m["name"], i, end, bool(m["pub"]), src.joined(i, 6, "{;"))
        elif m := _CONST.match(line):
            end = src.until(i, ";")
            src.add("variable", m["name"], i, end, bool(m["pub"]))
        elif m := _ALIAS.match(line):
            end = src.until(i, ";")
            src.add("type", m["name"], i, end, bool(m["pub"]))
        i = end + 1
