"""The boolean query language: lexer, parser and syntax tree.

Words, words with a trailing ``*``, quoted phrases, AND, OR, NOT in any case,
and parentheses. Adjacent terms are joined by AND. Precedence, tightest first:
adjacency, NOT, AND, OR; all group to the left.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from typing import NamedTuple

from leafmark.functions.text import CYRILLIC, LATIN, TOKEN, accents

OPERATORS = frozenset({"AND", "OR", "NOT"})
#: Fixed value: a word with one of these is matched as a phrase of its tokens.
SPECIAL = frozenset('-+*:^(){}"')
#: Fixed value: the forms of a token.
LEXER = re.compile(r'"(?P<phrase>[^"]*)"|(?P<word>[^\s()]+)|(?P<paren>[()])')
#: Digits and ASCII letters, the underscore, the substitute character and everything beyond ASCII.
BARE = re.compile(r"[A-Za-z0-9_\x1a\x80-\U0010ffff]+")
NORMALIZE = str.maketrans(CYRILLIC, LATIN)


class Token(NamedTuple):
    """A piece of a query; ``kind`` is word, phrase, operator or paren."""

    kind: str
    text: str

    @property
    def operand(self) -> bool:
        return self.kind in ("word", "phrase")


@dataclass(frozen=True)
class Leaf:
    """Tokens in a row; with ``prefix`` the last may go on. No tokens match nothing."""

    tokens: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class And:
    left: Node
    right: Node


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node


@dataclass(frozen=True)
class Not:
    left: Node
    right: Node


Node = Leaf | And | Or | Not


def tokenize_query(query: str) -> list[Token]:
    """Tokens in order; operators in upper case; a quote without partner is part of a word."""
    found = [Token(m.lastgroup, m[m.lastgroup]) for m in LEXER.finditer(query)]
    return [Token("operator", t.text.upper()) if t.kind == "word" and t.text.upper() in OPERATORS else t for t in found]


def text_tokens(text: str) -> tuple[str, ...]:
    """What ``functions.text.tokens`` gives for a Python string."""
    lower = "".join(c for c in text.lower() if unicodedata.category(c) != "Mn").translate(str.maketrans(*accents()))
    kinds = {"L", "N"}
    out, run = [], ""
    for c in lower + " ":
        if unicodedata.category(c)[0] in kinds or unicodedata.category(c) == "Co":
            run += c
        elif run:
            out.append(run)
            run = ""
    return tuple(out)


def _normal(text: str) -> str:
    return text.lower().translate(NORMALIZE)


def _leaf(token: Token) -> Leaf:
    if token.kind == "phrase":
        return Leaf(text_tokens(_normal(token.text)))
    prefix = token.text.endswith("*")
    core = _normal(token.text[:-1] if prefix else token.text)
    if SPECIAL & set(core):
        return Leaf(text_tokens(core))  # the star is lost
    if not BARE.fullmatch(core):
        raise ValueError(f"syntax error near {token.text!r}")
    return Leaf(text_tokens(core), prefix)


class _Parser:
    """Recursive descent with one level for each precedence."""

    def __init__(self, tokens: list[Token]) -> None:
        self.tokens, self.at = tokens, 0

    def here(self, kind: str, text: str) -> bool:
        """Step over a token if it is the next one."""
        if self.tokens[self.at : self.at + 1] != [Token(kind, text)]:
            return False
        self.at += 1
        return True

    def operand(self) -> Leaf | None:
        """Step over a word or phrase."""
        if self.at == len(self.tokens) or not self.tokens[self.at].operand:
            return None
        self.at += 1
        return _leaf(self.tokens[self.at - 1])

    def either(self) -> Node:
        node = self.both()
        while self.here("operator", "OR"):
            node = _or(node, self.both())
        return node

    def both(self) -> Node:
        node = self.without()
        while self.here("operator", "AND"):
            node = And(node, self.without())
        return node

    def without(self) -> Node:
        node = self.terms()
        while self.here("operator", "NOT"):
            right = self.terms()
            node = node if right == Leaf(()) else Not(node, right)
        return node

    def terms(self) -> Node:
        """Neighbouring words and phrases, or one parenthesis: it has no neighbours."""
        if self.here("paren", "("):
            node = self.either()
            if not self.here("paren", ")"):
                raise ValueError("unbalanced parenthesis")
            return node
        node: Node | None = self.operand()
        if node is None:
            raise ValueError("an operand is missing")
        while (more := self.operand()) is not None:
            node = more if node == Leaf(()) else node if more == Leaf(()) else And(node, more)
        return node


def _or(left: Node, right: Node) -> Node:
    return right if left == Leaf(()) else left if right == Leaf(()) else Or(left, right)


def parse(query: str) -> Node | None:
    """The tree of a query, None for a blank one; ValueError if the grammar rejects it."""
    tokens = tokenize_query(query)
    if not tokens:
        return None
    parser = _Parser(tokens)
    node = parser.either()
    if parser.at < len(tokens):
        raise ValueError(f"unexpected {tokens[parser.at].text!r}")
    return node


def leaves(node: Node) -> list[Leaf]:
    """Leaves in order, repeats included."""
    return [node] if isinstance(node, Leaf) else leaves(node.left) + leaves(node.right)
