"""One interface for search engines over an index."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame

from leafmark.operators import search as S
from leafmark.operators.filters import Filters


class SearchBackend(Protocol):
    """Capabilities are among basic_search, count, snippet and relevance."""

    capabilities: frozenset[str]

    def search(self, query: str, f: Filters = Filters(), limit: int = 50, offset: int = 0) -> DataFrame: ...

    def count(self, query: str, f: Filters = Filters()) -> int: ...


@dataclass(frozen=True)
class PageBackend:
    """Search over a page table or an index, and its documents."""

    pages: DataFrame | S.Searchable
    documents: DataFrame
    capabilities: frozenset[str] = frozenset({"basic_search", "count", "snippet", "relevance"})

    def search(self, query: str, f: Filters = Filters(), limit: int = 50, offset: int = 0) -> DataFrame:
        """Documents of the slice with their pages, snippets and terms; those that pass the filters for a blank query."""
        return S.search_with_pages(self.pages, self.documents, query, f, limit=limit, offset=offset)

    def count(self, query: str, f: Filters = Filters()) -> int:
        return S.count(self.pages, self.documents, query, f).head()["n_docs"]
