"""Parameters and table schemas."""

from __future__ import annotations

from dataclasses import dataclass, field

DOCUMENTS = (
    "doc_id string, doc_ord long, file_path string, title string, description string, word_count long, heading_count long, max_depth int, "
    "last_modified string, tags array<string>, content_hash string, collection string, facets map<string,array<string>>, references array<string>"
)
NODES = (
    "doc_id string, doc_ord long, ord int, node_id string, title string, level int, parent_id string, content string, summary string, "
    "word_count int, line_start int, line_end int, kind string, exported boolean, path array<string>"
)


@dataclass(frozen=True)
class Ranking:
    """All weights are applied at query time; none needs a new index."""

    k1: float = 1.2
    b: float = 0.75
    title_weight: float = 3.0
    code_weight: float = 1.5
    description_weight: float = 2.0
    term_proximity_bonus: float = 2.0
    full_coverage_bonus: float = 5.0
    prefix_penalty: float = 0.5


@dataclass(frozen=True)
class Collection:
    """A folder of markdown (kind "md") or source files (kind "code")."""

    name: str
    root: str
    weight: float = 1.0
    kind: str = "md"
    glob: str | None = None


@dataclass(frozen=True)
class Config:
    collections: tuple[Collection, ...] = field(default_factory=tuple)
    ranking: Ranking = field(default_factory=Ranking)
    glossary_path: str | None = None

    def weights(self) -> dict[str, float]:
        return {c.name: c.weight for c in self.collections}
