import pytest

from leafmark.plans.query import And, Leaf, Not, Or, Token, leaves, parse, text_tokens, tokenize_query

Word, Phrase, Operator, Paren = ((lambda text, kind=kind: Token(kind, text)) for kind in ("word", "phrase", "operator", "paren"))


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("", []), ("  \t ", []), ("гидро*", [Word("гидро*")]), ('"a   b"', [Phrase("a   b")]), ('""', [Phrase("")]), ("ANDROID", [Word("ANDROID")]), ("and Or NOT", [Operator("AND"), Operator("OR"), Operator("NOT")]),
        ("a(b)", [Word("a"), Paren("("), Word("b"), Paren(")")]), ('a"b c', [Word('a"b'), Word("c")]), ('"and"', [Phrase("and")]),
        ("(EC-423-1 OR x) NOT KM", [Paren("("), Word("EC-423-1"), Operator("OR"), Word("x"), Paren(")"), Operator("NOT"), Word("KM")]),
    ],
)
def test_tokens(text, tokens):
    assert tokenize_query(text) == tokens


def test_precedence_and_grouping():
    a, b, c, d = (Leaf((x,)) for x in "abcd")
    assert parse("a b NOT c AND d OR a") == Or(And(Not(And(a, b), c), d), a)
    assert parse("a OR b OR c") == Or(Or(a, b), c)
    assert parse("(a OR b) AND c") == And(Or(a, b), c)
    assert parse("a NOT b NOT c") == Not(Not(a, b), c)
    assert leaves(parse("a b a")) == [a, b, a]


def test_words_become_leaves():
    assert parse("ЕС-423-1") == Leaf(("ec", "423", "1"))
    assert parse("EC-4*") == Leaf(("ec", "4"))  # the star is lost in a quoted word
    assert parse("Дом*") == Leaf(("дom",), True)
    assert parse('"Café au"') == Leaf(("cafe", "au"))
    assert parse("a_b") == Leaf(("a", "b"))
    assert text_tokens("Café №5 ёж_й") == ("cafe", "5", "ёж", "й")


def test_empty_phrases():
    a = Leaf(("a",))
    assert parse('a ""') == a and parse('a OR ""') == a and parse('a NOT ""') == a
    assert parse('a AND ""') == And(a, Leaf(()))
    assert parse(" ") is None


@pytest.mark.parametrize("bad", ["NOT a", "a AND", "OR", "()", "*", "(a OR b) c", "a (b)", "(a", "a)", "12.5", "a,b", "o'k", "a AND OR b"])
def test_rejected(bad):
    with pytest.raises(ValueError):
        parse(bad)
