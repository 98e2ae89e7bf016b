"""The parsers as table functions, for SQL over a column of sources or texts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from papyra.operators import markdown
from papyra.operators.code import symbols

SYMBOLS = "ord int, name string, kind string, signature string, line_start int, line_end int, exported boolean, parent_ord int"
SECTIONS = "ord int, title string, level int, content string, line_start int, line_end int"


class CodeSymbols:
    """code_symbols(path, text): the symbols of one source file; of a null text none."""

    def eval(self, path: str | None, text: str | None) -> Iterator[tuple]:
        for k, s in enumerate(symbols(text, path or "")[1] if text is not None else []):
            yield k, s.name, s.kind, s.signature, s.start + 1, s.end + 1, s.exported, s.parent


class MarkdownSections:
    """markdown_sections(text): the sections of one markdown text, in block mode; of a null text none."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        for k, (level, title, content, a, z) in enumerate(markdown.block_sections(text) if text is not None else []):
            yield k, title, level, content, a, z


def register(spark: SparkSession) -> None:
    """Make code_symbols and markdown_sections known to a session's SQL; both are called with LATERAL. Rows are exchanged plain: of each call's few rows Arrow makes a batch, which takes longer than the parsers."""
    spark.udtf.register("code_symbols", F.udtf(CodeSymbols, returnType=SYMBOLS, useArrow=False))
    spark.udtf.register("markdown_sections", F.udtf(MarkdownSections, returnType=SECTIONS, useArrow=False))
