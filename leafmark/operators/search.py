"""Ranked full-text search over page tables.

Corpus statistics are taken over all pages before any filter. Ranking needs one
narrow pass; snippets are made for the documents of the requested slice only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.functions import text as T
from leafmark.operators import filters as Filter
from leafmark.plans import compile as C
from leafmark.plans.query import Leaf, Node, parse

#: Tokens of a snippet, and the words that it shows.
SNIPPET, SHOWN = 200, r"[\p{L}\p{N}\p{Co}\p{Mn}]+"


@runtime_checkable
class Searchable(Protocol):
    """An index that can take the place of a page table."""

    def matching(self, query: str) -> DataFrame: ...

    def pages(self) -> DataFrame: ...

    def top(self, documents: DataFrame, query: str, f: Filter.Filters, limit: int, offset: int): ...


def hits(source: DataFrame | Searchable, query: str) -> DataFrame:
    """(doc_id, page_number, score) of pages that match, from a page table or an index."""
    return source.matching(query) if isinstance(source, Searchable) else matching_pages(source, query)


def corpus_stats(pages: DataFrame) -> DataFrame:
    """One row: number of pages and their mean length."""
    return pages.agg(F.count("*").alias("n_pages"), F.avg("dl").alias("avg_dl"))


def matching_pages(pages: DataFrame, query: str, keep: tuple[str, ...] = ("doc_id", "page_number")) -> DataFrame:
    """(keep.., score) of pages that match; lower scores are better. ValueError for a bad query.

    Both passes read tokens and lengths only: one asks which leaves occur, for
    the statistics of all pages, the other counts them on pages that match.
    """
    node = parse(query)
    if node is None:
        raise ValueError("the query is empty")
    tf, tokens = C.tf_names(node), F.col("tokens")
    stats = pages.agg(F.count("*").alias("_pages"), F.avg("dl").alias("_mean"), *(F.sum(C.present(leaf, tokens).cast("long")).alias(f"_df{n}") for leaf, n in tf.items()))
    hits = pages.filter(C.matches(node, tokens)).select(*keep, "dl", *(C.frequency(leaf, tokens).alias(n) for leaf, n in tf.items()))
    return hits.crossJoin(F.broadcast(stats)).select(*keep, (-C.score(node, tf)).alias("score"))  # one row of statistics


def ranked_documents(pages: DataFrame | Searchable, documents: DataFrame, query: str, f: Filter.Filters = Filter.Filters()) -> DataFrame:
    """(doc_id, file_path, score, n_pages) of matching documents; a document's score is its best page's."""
    return rank(hits(pages, query), documents, f)


def rank(hits: DataFrame, documents: DataFrame, f: Filter.Filters = Filter.Filters()) -> DataFrame:
    """(doc_id, file_path, score, n_pages) of the documents of ``hits``, which a page table or an inverted index gave."""
    best = hits.groupBy("doc_id").agg(F.min("score").alias("score"), F.count("*").alias("n_pages"))
    return best.join(Filter.apply(documents, f).select("doc_id", "file_path"), "doc_id").select("doc_id", "file_path", "score", "n_pages")


def search(pages: DataFrame | Searchable, documents: DataFrame, query: str, f: Filter.Filters = Filter.Filters(), limit: int = 50, offset: int = 0) -> DataFrame:
    """The slice of documents by (score, doc_id); a blank query lists documents by path with score 0."""
    Filter.check_request(limit, offset)
    if parse(query) is None:
        return list_documents(documents, f, limit, offset)
    if isinstance(pages, Searchable) and (top := pages.top(documents, query, f, limit, offset)) is not None:
        return top.rows
    return ranked_documents(pages, documents, query, f).orderBy("score", "doc_id").offset(offset).limit(limit)


def search_with_count(pages: DataFrame | Searchable, documents: DataFrame, query: str, f: Filter.Filters = Filter.Filters(), limit: int = 50, offset: int = 0) -> DataFrame:
    """``search`` with ``n_docs``, the number of documents that match, from one pass over the matches; no rows beyond the last slice."""
    Filter.check_request(limit, offset)
    if parse(query) is None:
        found = Filter.apply(documents, f).select("doc_id", "file_path").distinct().select("*", F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("n_pages"))
        order = ["file_path", "doc_id"]
    else:
        found, order = ranked_documents(pages, documents, query, f), ["score", "doc_id"]
    # the count asks for the same columns as the slice, so both read one exchange of the matches
    total = found.agg(F.count(F.when(F.col("n_pages") > 0, F.col("score"))).alias("n_docs"))
    return found.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def list_documents(documents: DataFrame, f: Filter.Filters, limit: int = 50, offset: int = 0) -> DataFrame:
    rows = Filter.apply(documents, f).select("doc_id", "file_path").distinct()
    return rows.orderBy("file_path", "doc_id").offset(offset).limit(limit).select("doc_id", "file_path", F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("n_pages"))


def count(pages: DataFrame | Searchable, documents: DataFrame, query: str, f: Filter.Filters = Filter.Filters()) -> DataFrame:
    """One row with the number of documents that ``search`` ranks."""
    chosen, node = Filter.apply(documents, f), parse(query)
    if node is None:
        return chosen.agg(F.countDistinct("doc_id").alias("n_docs"))
    found = pages.matching(query) if isinstance(pages, Searchable) else pages.filter(C.matches(node, F.col("tokens")))
    return found.select("doc_id").join(chosen.select("doc_id"), "doc_id", "left_semi").agg(F.countDistinct("doc_id").alias("n_docs"))


def _covers(leaf: Leaf, tokens: Column, i: Column, upto: int) -> Column:
    return reduce(lambda a, b: a | b, (C.starts(leaf, tokens, i - o) for o in range(upto)), F.lit(False))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def snippet(node: Node, size: int = SNIPPET) -> Column:
    """The normalised text of a page with its matches marked, denormalised.

    Adjacent matches stay apart; phrases that share tokens are marked as one. A
    page over ``size`` tokens is cut to a window around its first match, with
    dots at cut edges.
    """
    text, tokens = F.col("normalized_text"), F.col("tokens")
    marks = C.positive(node)
    hit = lambda i: reduce(lambda a, b: a | b, (_covers(leaf, tokens, i, len(leaf.tokens)) for leaf in marks), F.lit(False))
    tied = lambda i: reduce(lambda a, b: a | b, (_covers(leaf, tokens, i, len(leaf.tokens) - 1) for leaf in marks if len(leaf.tokens) > 1), F.lit(False))
    n = F.size(tokens)
    # the first match is where one of the marks begins
    first = F.array_position(F.transform(tokens, lambda t, i: reduce(lambda a, b: a | b, (C.starts(leaf, tokens, i) for leaf in marks), F.lit(False))), True).cast("int") - 1
    begin = F.when(n <= size, F.lit(0)).otherwise(_let(first, lambda x: F.greatest(F.lit(0), F.least(x - (size - 1) // 2, n - size))))
    # folding drops combining marks, so the shown words are found again in the unfolded text
    parts = F.struct(begin.alias("begin"), F.regexp_extract_all(text, F.lit(SHOWN), F.lit(0)).alias("shown"), F.split(text, SHOWN).alias("between"))

    def body(p: Column) -> Column:
        begin, between = p["begin"], p["between"]
        end = F.least(begin + size, n)

        def piece(t: Column, at: Column) -> Column:
            i = begin + at
            word = F.concat(F.when(hit(i) & ~tied(i - 1), T.MARK_START).otherwise(""), t, F.when(hit(i) & ~tied(i), T.MARK_END).otherwise(""))
            return F.concat(word, F.when((i < end - 1) | (end == n), F.get(between, i + 1)).otherwise(""))

        words = F.array_join(F.transform(F.slice(p["shown"], begin + 1, F.greatest(end - begin, F.lit(0))), piece), "")
        head = F.when(begin > 0, "...").otherwise(F.get(between, F.lit(0)))
        return F.concat(head, words, F.when(end < n, "...").otherwise(""))

    return T.denormalize_text(_let(parts, body))


def page_hits(pages: DataFrame | Searchable, query: str, doc_ids: DataFrame | list) -> DataFrame:
    """(doc_id, page_number, snippet, terms) of the matching pages of some documents; a list of ids reaches the scan as a filter."""
    node = parse(query)
    pages = pages.pages() if isinstance(pages, Searchable) else pages
    chosen = pages.filter(F.col("doc_id").isin(doc_ids)) if isinstance(doc_ids, list) else pages.join(doc_ids.select("doc_id"), "doc_id", "left_semi")
    shown = chosen.filter(C.matches(node, F.col("tokens"))).select("doc_id", "page_number", snippet(node).alias("snippet"))
    return shown.withColumn("terms", T.snippet_terms(F.col("snippet")))


def search_with_pages(pages: DataFrame | Searchable, documents: DataFrame, query: str, f: Filter.Filters = Filter.Filters(), limit: int = 50, offset: int = 0) -> DataFrame:
    """``search`` with an array of (page_number, snippet, terms) in page order; a blank query has one virtual page 0.

    The slice, 500 rows at most, is ranked first; then only its documents' pages are read.
    """
    top = search(pages, documents, query, f, limit, offset)
    if parse(query) is None:
        empty = F.struct(F.lit(0).alias("page_number"), F.lit("").alias("snippet"), F.array().cast("array<string>").alias("terms"))
        return top.withColumn("pages", F.array(empty))
    rows = top.collect()
    known = top.sparkSession.createDataFrame(rows, top.schema)
    shown = page_hits(pages, query, [r["doc_id"] for r in rows])
    grouped = shown.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "snippet", "terms"))).alias("pages"))
    return F.broadcast(known).join(grouped, "doc_id").orderBy("score", "doc_id")


def neighbours(hits: DataFrame) -> DataFrame:
    """``hits`` (doc_id, page_number) with the matching pages before and after each in its document."""
    order = Window.partitionBy("doc_id").orderBy("page_number")
    return hits.select("doc_id", "page_number", F.lag("page_number").over(order).alias("previous_page"), F.lead("page_number").over(order).alias("next_page"))


def postings(pages: DataFrame) -> DataFrame:
    """(term, doc_id, page_number, tf, positions): the inverted index."""
    rows = pages.select("doc_id", "page_number", F.posexplode("tokens").alias("position", "term"))
    grouped = rows.groupBy("term", "doc_id", "page_number").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))
    return grouped


def write_index(pages: DataFrame, path: str) -> DataFrame:
    """The page table in Parquet; searches read it instead of tokenising again.

    Each file is sorted by document, without a shuffle, so that the pages of a
    few documents are a few of its row groups.
    """
    pages.sortWithinPartitions("doc_id", "page_number").write.mode("overwrite").parquet(path)
    return pages.sparkSession.read.parquet(path)


def write_postings(pages: DataFrame, path: str) -> None:
    """The inverted index of a page table below ``path``: postings sorted by term, and the statistics of the corpus.

    Postings are dealt by range of (term, doc_id), so a frequent term is many
    files and a search reads the row groups of its terms.
    """
    rows = pages.select("doc_id", "page_number", "dl", F.posexplode("tokens").alias("position", "term"))
    grouped = rows.groupBy("term", "doc_id", "page_number").agg(F.first("dl").alias("dl"), F.sort_array(F.collect_list("position")).alias("positions"))
    grouped.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id", "page_number").write.mode("overwrite").parquet(f"{path}/postings")
    corpus_stats(pages).write.mode("overwrite").parquet(f"{path}/stats")


def matching_postings(spark: SparkSession, path: str, query: str) -> DataFrame:
    """What ``matching_pages`` gives, from the inverted index at ``path``: only the terms of the query are read."""
    node = parse(query)
    if node is None:
        raise ValueError("the query is empty")
    tf = C.tf_names(node)
    whole = {t for leaf in tf for t in (leaf.tokens[:-1] if leaf.prefix else leaf.tokens)}
    begins = {leaf.tokens[-1] for leaf in tf if leaf.prefix and leaf.tokens}
    wanted = reduce(lambda a, b: a | b, (F.startswith("term", F.lit(p)) for p in sorted(begins)), F.col("term").isin(sorted(whole)))
    read = spark.read.parquet(f"{path}/postings").filter(wanted)

    def places(leaf: Leaf, at: int) -> Column:
        fits = F.startswith("term", F.lit(leaf.tokens[at])) if leaf.prefix and at == len(leaf.tokens) - 1 else F.col("term") == leaf.tokens[at]
        return F.flatten(F.collect_list(F.when(fits, F.col("positions"))))

    lists = {(n, at): places(leaf, at) for leaf, n in tf.items() for at in range(len(leaf.tokens))}
    found = read.groupBy("doc_id", "page_number").agg(F.first("dl").alias("dl"), *(x.alias(f"{n}_{at}") for (n, at), x in lists.items()))

    def frequency(leaf: Leaf, n: str) -> Column:
        if not leaf.tokens:
            return F.lit(0)
        follows = lambda x: reduce(lambda a, b: a & b, (F.array_contains(f"{n}_{k}", x + k) for k in range(1, len(leaf.tokens))), F.lit(True))
        return F.size(F.filter(f"{n}_0", follows))

    counted = found.select("doc_id", "page_number", "dl", *(frequency(leaf, n).alias(n) for leaf, n in tf.items()))
    known = spark.read.parquet(f"{path}/stats").select(F.col("n_pages").alias("_pages"), F.col("avg_dl").alias("_mean"))
    with_leaf = counted.agg(*(F.coalesce(F.sum((F.col(n) > 0).cast("long")), F.lit(0)).alias(f"_df{n}") for n in tf.values()))
    hits = counted.filter(C.predicate(node, tf)).crossJoin(F.broadcast(known)).crossJoin(F.broadcast(with_leaf))  # one row each
    return hits.select("doc_id", "page_number", (-C.score(node, tf)).alias("score"))
