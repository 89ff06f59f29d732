"""From the syntax tree to columns over a page table with ``tokens`` and ``normalized_text``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmark.plans.query import And, Leaf, Node, Not, Or, leaves

#: Weights of the ranking formula.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def _fits(leaf: Leaf, token: Column, at: int) -> Column:
    last = at == len(leaf.tokens) - 1
    return F.startswith(token, F.lit(leaf.tokens[at])) if leaf.prefix and last else token == leaf.tokens[at]


def starts(leaf: Leaf, tokens: Column, i: Column) -> Column:
    """Whether an occurrence begins at token ``i`` (0-based); never null."""
    parts = [F.coalesce(_fits(leaf, F.get(tokens, i + k), k), F.lit(False)) for k in range(len(leaf.tokens))]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def frequency(leaf: Leaf, tokens: Column) -> Column:
    """Occurrences of a leaf in an array of tokens."""
    if not leaf.tokens:
        return F.lit(0)
    if len(leaf.tokens) == 1:
        return F.size(F.filter(tokens, lambda t: _fits(leaf, t, 0)))
    return F.size(F.filter(tokens, lambda t, i: _fits(leaf, t, 0) & starts(leaf, tokens, i)))


def present(leaf: Leaf, tokens: Column) -> Column:
    """Whether a leaf occurs. Whole words are looked up in compiled code; only pages that hold all of a phrase's words walk over them."""
    if not leaf.tokens:
        return F.lit(False)
    whole = leaf.tokens[:-1] if leaf.prefix else leaf.tokens
    found = [F.array_contains(tokens, t) for t in dict.fromkeys(whole)]
    if len(leaf.tokens) > 1:
        found.append(frequency(leaf, tokens) > 0)
    elif leaf.prefix:
        found.append(F.exists(tokens, lambda t: _fits(leaf, t, 0)))
    return reduce(lambda a, b: a & b, found)


def matches(node: Node, tokens: Column) -> Column:
    """Whether a page matches."""
    if isinstance(node, Leaf):
        return present(node, tokens)
    left, right = matches(node.left, tokens), matches(node.right, tokens)
    return left & right if isinstance(node, And) else left | right if isinstance(node, Or) else left & ~right


def tf_names(node: Node) -> dict[Leaf, str]:
    """A column name for each different leaf."""
    return {leaf: f"_tf{i}" for i, leaf in enumerate(dict.fromkeys(leaves(node)))}


def predicate(node: Node, tf: dict[Leaf, str]) -> Column:
    """Whether a branch is satisfied, from the frequencies of its leaves."""
    if isinstance(node, Leaf):
        return F.col(tf[node]) > 0
    left, right = predicate(node.left, tf), predicate(node.right, tf)
    return left & right if isinstance(node, And) else left | right if isinstance(node, Or) else left & ~right


def bm25(frequency: Column, pages_with: Column, pages: Column, length: Column, mean: Column) -> Column:
    """The share of a leaf in a page's score: positive, larger is better."""
    idf = F.log((pages - pages_with + 0.5) / (pages_with + 0.5))
    idf = F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF))
    return idf * frequency * (K1 + 1) / (frequency + K1 * (1 - B + B * length / mean))


def score(node: Node, tf: dict[Leaf, str]) -> Column:
    """Sum over satisfied leaves: OR adds the branches that match, NOT its left side; a repeated leaf counts again."""
    if isinstance(node, Leaf):
        name = tf[node]
        return bm25(F.col(name), F.col(f"_df{name}"), F.col("_pages"), F.col("dl"), F.col("_mean"))
    if isinstance(node, Not):
        return score(node.left, tf)
    if isinstance(node, And):
        return score(node.left, tf) + score(node.right, tf)
    zero = F.lit(0.0)
    return F.when(predicate(node.left, tf), score(node.left, tf)).otherwise(zero) + F.when(predicate(node.right, tf), score(node.right, tf)).otherwise(zero)


def positive(node: Node) -> list[Leaf]:
    """Different leaves that a snippet marks: all but those behind NOT."""
    found = [node] if isinstance(node, Leaf) else positive(node.left) + ([] if isinstance(node, Not) else positive(node.right))
    return [leaf for leaf in dict.fromkeys(found) if leaf.tokens]
