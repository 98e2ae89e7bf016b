"""Symbols of other languages by families (C12): C, Ruby, shell, Kotlin, Scala, C#, Swift, PHP, Lua, R."""

from __future__ import annotations

import re

from papyra.operators.code.scan import Source

EXTENSIONS = ("kt", "scala", "c", "cpp", "cc", "h", "hpp", "cs", "rb", "swift", "php", "lua", "r", "sh", "bash", "zsh")

_FAMILIES = {"java": ("kt", "scala", "cs"), "c": ("c", "cpp", "cc", "h", "hpp"), "ruby": ("rb",), "shell": ("sh", "bash", "zsh")}
_IMPORTS = {
    "java": re.compile(r"(?:import|package|using|namespace)\s"),
    "c": re.compile(r"#\s*include\b"),
    "ruby": re.compile(r"(?:require|require_relative|include)\b"),
    "shell": re.compile(r"(?:source|\.)\s"),
    "other": re.compile(r"(?:import|use|require|include|library|local\s+\w+\s*=\s*require)\b"),
}
_WORDS = r"(?:(?:public|private|protected|internal|export|pub|abstract|final|static|sealed|open|partial|data|case|default)\s+)*"
_CLASS = re.compile(rf"{_WORDS}(?:struct|class|object)\s+(?P<name>\w+)", re.A)
_INTERFACE = re.compile(rf"{_WORDS}(?:interface|trait|protocol)\s+(?P<name>\w+)", re.A)
_ENUM = re.compile(r"(?:pub\s+)?(?:export\s+)?enum\s+(?:class\s+)?(?P<name>\w+)", re.A)
_FUNCTION = re.compile(rf"{_WORDS}(?:async\s+)?(?:local\s+)?(?:fn|func|function|def|sub)\s+(?P<name>[\w.:]+)\s*\(", re.A)
_RUBY_DEF = re.compile(r"def\s+(?P<name>(?:self\.)?\w+[?!=]?)", re.A)
_SHELL = re.compile(r"(?:function\s+)?(?P<name>[\w-]+)\s*\(\)", re.A)
_QUALIFIED = re.compile(r"[\w:<>,*&~\s]*?(?P<name>\w+(?:::~?\w+)+)\s*\(", re.A)
_C_FUNCTION = re.compile(r"(?P<type>[\w:<>,*&\s]+?[\s*&])(?P<name>\w+)\s*\(", re.A)
_TYPED = re.compile(rf"{_WORDS}(?:(?:virtual|override|async|readonly|unsafe)\s+)*[\w<>\[\],?.]+\s+(?P<name>\w+)\s*\(", re.A)
#: Words before a parenthesis that are no C functions.
_NOT_C = frozenset("if for while switch return sizeof catch else do typedef".split())


def family(ext: str) -> str:
    return next((f for f, exts in _FAMILIES.items() if ext in exts), "other")


def _ruby_end(src: Source, i: int) -> int:
    depth = 0
    for k in range(i, len(src)):
        t = src.trimmed[k]
        if re.match(r"(?:class|module|def|if|unless|case|while|until|begin|for)\b", t) or re.search(r"\bdo(?:\s*\|[^|]*\|)?$", t):
            depth += 1
        if re.match(r"end\b", t):
            depth -= 1
            if depth <= 0:
                return k
    return len(src) - 1


def _exported(kind: str, t: str, name: str) -> bool:
    if kind == "java":
        return "public " in t
    if kind == "ruby":
        return not name.startswith("_")
    return t.startswith(("export ", "pub ", "public "))


def _members(src: Source, owner: int, start: int, end: int, kind: str) -> None:
    i = start + 1
    while i < end:
        t = src.trimmed[i]
        m = _RUBY_DEF.match(t) if kind == "ruby" else _FUNCTION.match(t)
        if not m and kind == "java" and (m := _TYPED.match(t)) and (m["name"] in _NOT_C or t.startswith(("return ", "new ", "throw ", "else "))):
            m = None
        if m:
            stop = min(_ruby_end(src, i) if kind == "ruby" else src.statement(i, end - 1), end)
            src.add("method", m["name"], i, stop, _exported(kind, t, m["name"]), parent=owner)
            i = max(stop, i)
        i += 1


def parse(src: Source, ext: str = "") -> None:
    kind, n = family(ext), len(src)
    named = _IMPORTS[kind]
    first = next((k for k, t in enumerate(src.trimmed) if named.match(t)), None)
    if first is not None:
        last = first
        for k in range(first, n):
            if named.match(src.trimmed[k]):
                last = k
            elif src.trimmed[k]:
                break
        src.add("import", "imports", first, last, signature=src.trimmed[first])
    i = 0
    while i < n:
        line, t, end = src.lines[i], src.trimmed[i], i
        if not t or t.startswith(("//", "#", "*", "/*")) and not t.startswith("#!") or (line[:1].isspace() and kind != "java"):
            i += 1
            continue
        if (m := _CLASS.match(t)) and not (kind == "c" and t.rstrip().endswith(";")):
            end = _ruby_end(src, i) if kind == "ruby" else src.braces(i)
            at = src.add("class", m["name"], i, end, _exported(kind, t, m["name"]))
            _members(src, at, i, end, kind)
        elif m := _INTERFACE.match(t):
            end = src.braces(i)
            src.add("interface", m["name"], i, end, _exported(kind, t, m["name"]))
        elif m := _ENUM.match(t):
            end = src.braces(i)
            src.add("enum", m["name"], i, end, _exported(kind, t, m["name"]))
        elif m := (_RUBY_DEF.match(t) if kind == "ruby" else _SHELL.match(t) if kind == "shell" else _FUNCTION.match(t)):
            end = _ruby_end(src, i) if kind == "ruby" else src.braces(i)
            src.add("function", m["name"], i, end, _exported(kind, t, m["name"]))
        elif kind == "c" and (m := _QUALIFIED.match(t)) and "{" in " ".join(src.trimmed[i : i + 3]) and not t.endswith(";"):
            end = src.braces(i)
            src.add("function", m["name"], i, end, True)
        elif kind == "c" and (m := _C_FUNCTION.match(t)) and m["name"] not in _NOT_C and m["type"].strip().split()[-1:] != ["return"] and "=" not in t.split("(")[0]:
            end = src.statement(i)  # a prototype ends at its semicolon
            src.add("function", m["name"], i, end, not t.startswith("static"))
        i = end + 1
