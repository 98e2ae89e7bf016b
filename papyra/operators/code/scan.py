"""What the line-based symbol scanners share (C13): symbols, balanced ends, signatures."""

from __future__ import annotations

from dataclasses import dataclass


def word(text: str) -> tuple[str, str]:
    """The word that text begins with (or ""), and what comes after it and white space."""
    n = 0
    while n < len(text) and (text[n].isalnum() or text[n] == "_"):
        n += 1
    return text[:n], text[n:].lstrip()


def bracketed(text: str, pair: str) -> tuple[str, str]:
    """What stands in the brackets that text begins with, and what comes after; ("", text) without them."""
    if not text.startswith(pair[0]):
        return "", text
    depth = 0
    for k, c in enumerate(text):
        depth += (c == pair[0]) - (c == pair[1])
        if depth == 0:
            return text[1:k].strip(), text[k + 1 :].lstrip()
    return "", text


@dataclass
class Symbol:
    kind: str
    name: str
    signature: str
    start: int  # from 0, inclusive
    end: int
    exported: bool
    parent: int | None  # place of the parent in the list


class Source:
    """Lines of a file and the symbols found so far."""

    def __init__(self, text: str):
        self.lines = text.split("\n")
        self.trimmed = [x.strip() for x in self.lines]
        self.symbols: list[Symbol] = []

    def __len__(self) -> int:
        return len(self.lines)

    def add(self, kind: str, name: str, start: int, end: int, exported: bool = False, signature: str | None = None, parent: int | None = None) -> int:
        end = max(start, min(end, len(self.lines) - 1))
        head = self.head(start) if signature is None else signature
        self.symbols.append(Symbol(kind, name, head, start, end, exported, parent))
        return len(self.symbols) - 1

    def head(self, i: int) -> str:
        """A line without its opening brace."""
        return self.trimmed[i].rstrip("{").rstrip()

    def joined(self, i: int, most: int, stops: str) -> str:
        """Lines from i on until one has a stop character, at most so many, as one signature."""
        parts = []
        for line in self.trimmed[i : i + most]:
            cut = min((line.find(c) for c in stops if c in line), default=-1)
            parts.append(line if cut < 0 else line[:cut])
            if cut >= 0:
                break
        return " ".join(p.strip() for p in parts if p.strip()).rstrip()

    def content(self, s: Symbol) -> str:
        return "\n".join(self.lines[s.start : s.end + 1])

    def braces(self, i: int, missing: int | None = None, last: int | None = None) -> int:
        """Line where the first block that opens at or after line i closes; `missing` if none opens."""
        return self._balance(i, "{", "}", i if missing is None else missing, last)

    def brackets(self, i: int) -> int:
        return self._balance(i, "([{", ")]}", i, None)

    def _balance(self, i: int, opening: str, closing: str, missing: int, last: int | None) -> int:
        depth, opened = 0, False
        stop = len(self.lines) if last is None else min(last + 1, len(self.lines))
        for k in range(i, stop):
            for c in self.lines[k]:
                if c in opening:
                    depth, opened = depth + 1, True
                elif c in closing:
                    depth -= 1
                    if opened and depth <= 0:
                        return k
        return missing if not opened else stop - 1

    def statement(self, i: int, last: int | None = None) -> int:
        """Line of the first `;` before any block, else where the block closes."""
        stop = len(self.lines) if last is None else min(last + 1, len(self.lines))
        for k in range(i, stop):
            line = self.lines[k]
            brace, semi = line.find("{"), line.find(";")
            if semi >= 0 and (brace < 0 or semi < brace):
                return k
            if brace >= 0:
                return self.braces(k, k, last)
        return i

    def until(self, i: int, mark: str) -> int:
        """First line at or after i with the mark; i if there is none."""
        return next((k for k in range(i, len(self.lines)) if mark in self.lines[k]), i)
