"""Document filters: code equality, path patterns, unmatched documents, module views."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.functions import text as T

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@dataclass(frozen=True)
class Filters:
    """Empty codes are no filters; an empty path is one. ``unmatched_only`` ignores the codes but not path and modules."""

    file_path: str | None = None
    object_code: str | None = None
    discipline_code: str | None = None
    document_type_code: str | None = None
    unmatched_only: bool = False
    modules: dict[str, dict[str, object]] = field(default_factory=dict)

    @property
    def any_ordinary(self) -> bool:
        return bool(self.file_path or self.object_code or self.discipline_code or self.document_type_code)


def identifier(name: str, what: str = "name") -> str:
    """``name``, or ValueError if it isn't a plain identifier."""
    if not IDENTIFIER.fullmatch(name):
        raise ValueError(f"{name!r} is no valid {what}")
    return name


def condition(f: Filters) -> Column:
    """The filters on the columns of a document; holds for all if there are none."""
    out = F.lit(True)
    if f.file_path is not None:
        out = out & T.like_ascii(F.col("file_path"), f.file_path)
    if f.unmatched_only:
        return out & (F.col("unmatched_flag") == 1)
    for column in ("object_code", "discipline_code", "document_type_code"):
        if value := getattr(f, column):
            out = out & (F.col(column) == value)
    return out


def apply(documents: DataFrame, f: Filters) -> DataFrame:
    """Documents that pass; a module view that doesn't exist is skipped.

    Views are joined as sets of doc_ids, so a view with several rows a document
    doesn't multiply documents.
    """
    out, spark = documents.filter(condition(f)), documents.sparkSession
    for view, wanted in f.modules.items():
        if not spark.catalog.tableExists(identifier(view, "view")):
            continue
        rows = spark.table(view)
        for name, value in wanted.items():
            rows = rows.filter(F.col(identifier(name, "field")) == value)
        out = out.join(rows.select("doc_id"), "doc_id", "left_semi")
    return out


def request(query: str, f: Filters, mode: str) -> tuple[str, Filters]:
    """The effective query and filters of a search mode: ``normal``, ``filters`` or ``content``."""
    if mode == "content":
        return query, Filters()
    if f.unmatched_only and not f.any_ordinary and mode == "normal":
        f = replace(f, unmatched_only=False)
    if mode == "filters":
        return "", f
    if mode == "normal":
        return query, f
    raise ValueError(f"unknown mode {mode!r}")


def page_of(number: int, size: int = 16) -> tuple[int, int]:
    """Limit and offset of a page counted from 1."""
    if number < 1:
        raise ValueError("pages count from 1")
    return size, (number - 1) * size


def check_request(limit: int, offset: int, terms: list[str] | None = None) -> None:
    """ValueError for limits beyond 1 to 500, negative offsets, over 200 terms, terms over 500 characters or 20 words."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1 to 500 and offset 0 or more")
    if terms is not None and (len(terms) > 200 or any(len(t) > 500 or len(t.split()) > 20 for t in terms)):
        raise ValueError("too many or too long terms")
