"""Search against SQLite's own full-text engine, and the rules around it."""

import random
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from leafmark.functions import text as T
from leafmark.operators import filters, search
from leafmark.operators.filters import Filters
from leafmark.plans.query import And, Leaf, Node, Not, Or
from leafmark.sources import tables

WORDS = "alpha beta gamma delta alphabet корпус дробление EC-423-1".split()


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(7)
    rows = [(f"d{i // 3}", i % 3, " ".join(r.choices(WORDS, k=r.randint(1, 12)))) for i in range(90)]
    pages = tables.index_pages(spark.createDataFrame(rows, "doc_id string, page_number int, text string")).cache()
    docs = spark.createDataFrame([(f"d{i}", f"dir{i % 2}/f{i}.pdf", "A" if i % 2 else None, None, None, int(i % 3 == 0)) for i in range(30)], "doc_id string, file_path string, object_code string, discipline_code string, document_type_code string, unmatched_flag int")
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE p USING fts5(doc_id, page_number, text_content, normalized_text, tokenize='unicode61')")
    normal = str.maketrans(T.CYRILLIC, T.LATIN)
    db.executemany("INSERT INTO p VALUES (?, ?, ?, ?)", [(d, str(n), t, t.lower().translate(normal)) for d, n, t in rows])
    return pages, docs, db


def match(node: Node) -> str:
    """The tree in the other engine's words, fully parenthesised."""
    if isinstance(node, Leaf):
        return "normalized_text: \"" + " ".join(node.tokens) + '"' + "*" * node.prefix
    op = {And: "AND", Or: "OR", Not: "NOT"}[type(node)]
    return f"({match(node.left)} {op} {match(node.right)})"


def some_tree(r: random.Random, depth: int) -> Node:
    if depth == 0 or r.random() < 0.25:
        kind = r.random()
        words = [w for w in WORDS if "-" not in w]
        normal = str.maketrans(T.CYRILLIC, T.LATIN)
        pick = lambda: r.choice(words).translate(normal)
        return Leaf((pick(), pick())) if kind < 0.25 else Leaf((pick()[:3],), True) if kind < 0.45 else Leaf((pick(),))
    return r.choice([And, Or, Or, Not])(some_tree(r, depth - 1), some_tree(r, depth - 1))


def text_of(node: Node) -> str:
    if isinstance(node, Leaf):
        words = " ".join(node.tokens)
        return f'"{words}"' if len(node.tokens) > 1 else words + "*" * node.prefix
    op = {And: "AND", Or: "OR", Not: "NOT"}[type(node)]
    return f"({text_of(node.left)} {op} {text_of(node.right)})"


def simple_not(node: Node) -> bool:
    """Without the shape, an OR branch ``(a AND b) NOT c``, whose scores are known to differ."""
    if isinstance(node, Leaf):
        return True
    if isinstance(node, Or) and any(isinstance(x, Not) for x in (node.left, node.right)):
        return False
    return simple_not(node.left) and simple_not(node.right)


def test_random_queries_agree_with_sqlite(spark, corpus):
    pages, _, db = corpus
    r = random.Random(11)
    for _ in range(25):
        node = some_tree(r, 2)
        got = {(x.doc_id, x.page_number): x.score for x in search.matching_pages(pages, text_of(node)).collect()}
        want = {(d, int(n)): s for d, n, s in db.execute("SELECT doc_id, page_number, bm25(p) FROM p WHERE p MATCH ?", (match(node),))}
        assert got.keys() == want.keys(), text_of(node)
        if simple_not(node):
            assert all(abs(got[k] - want[k]) < 1e-9 for k in got), text_of(node)


def test_hyphen_code_and_normalised_letters(corpus):
    pages, docs, db = corpus
    got = search.ranked_documents(pages, docs, "ЕС-423-1").count()
    assert got == db.execute("SELECT COUNT(DISTINCT doc_id) FROM p WHERE p MATCH 'normalized_text: \"ec-423-1\"'").fetchone()[0] > 0


def test_order_paging_and_count(corpus):
    pages, docs, _ = corpus
    whole = [(round(r.score, 9), r.doc_id) for r in search.search(pages, docs, "alpha*", limit=500).collect()]
    assert whole == sorted(whole) and len(whole) == search.count(pages, docs, "alpha*").head()[0]
    second = [r.doc_id for r in search.search(pages, docs, "alpha*", limit=5, offset=5).collect()]
    assert second == [d for _, d in whole[5:10]]
    with pytest.raises(ValueError):
        search.search(pages, docs, "alpha", limit=501)


def test_blank_query_lists_documents(corpus):
    pages, docs, _ = corpus
    rows = search.search_with_pages(pages, docs, " ", limit=3).collect()
    assert [r.file_path for r in rows] == sorted(f"dir{i % 2}/f{i}.pdf" for i in range(30))[:3]
    assert all(r.score == 0 and len(r.pages) == 1 and r.pages[0].snippet == "" and r.pages[0].terms == [] for r in rows)


def test_filters(corpus):
    pages, docs, _ = corpus
    ids = lambda f: {r.doc_id for r in filters.apply(docs, f).collect()}
    assert ids(Filters(object_code="A")) == {f"d{i}" for i in range(1, 30, 2)}
    assert ids(Filters(object_code="")) == {f"d{i}" for i in range(30)}
    assert ids(Filters(file_path="")) == set()
    assert ids(Filters(file_path="DIR1/f1_.%")) == {f"d{i}" for i in range(11, 20, 2)}
    assert ids(Filters(unmatched_only=True, object_code="B", file_path="dir0%")) == {f"d{i}" for i in range(0, 30, 6)}
    docs.sparkSession.createDataFrame([("d1", 1), ("d1", 1), ("d2", 0)], "doc_id string, good int").createOrReplaceTempView("good_ones")
    assert ids(Filters(modules={"good_ones": {"good": 1}, "absent": {"x": 1}})) == {"d1"}
    assert filters.apply(docs, Filters(modules={"good_ones": {}})).count() == 2
    with pytest.raises(ValueError):
        ids(Filters(modules={"a b": {}}))


def test_like_folds_ascii_only(spark):
    df = spark.createDataFrame([("АБВ.pdf",), ("абв.PDF",), ("a.b",), ("a\nb",)], "p string")
    hit = lambda p: [r.p for r in df.filter(T.like_ascii(F.col("p"), p)).collect()]
    assert hit("абв.pdf") == ["абв.PDF"] and hit("%.pdf") == ["АБВ.pdf", "абв.PDF"] and hit("A_B") == ["a.b", "a\nb"] and hit("a\\b") == []


def test_request_modes():
    f = Filters(unmatched_only=True)
    assert filters.request("q", f, "normal") == ("q", Filters()) and filters.request("q", f, "filters") == ("", f) and filters.request("q", f, "content") == ("q", Filters())
    assert filters.page_of(3) == (16, 32)


def test_snippets_and_terms(spark):
    rows = [("a", 0, "корпус и гидрошпонка и дробление"), ("b", 0, "x y z x y x"), ("c", 0, " ".join(["w"] * 300 + ["hit"] + ["w"] * 300)), ("d", 0, "aa ab, zz")]
    pages = tables.index_pages(spark.createDataFrame(rows, "doc_id string, page_number int, text string"))
    show = lambda q, d: search.page_hits(pages, q, spark.createDataFrame([(d,)], "doc_id string")).head()
    assert show("корпус OR гидрошпонка OR дробление", "a").terms == ["корпус", "гидрошпонка", "дробление"]
    s, e = T.MARK_START, T.MARK_END
    assert show('"x y" OR "y z"', "b").snippet == f"{s}х у z{e} {s}х у{e} х"  # letters that look Cyrillic come back as such
    cut = show("hit", "c").snippet
    assert cut.startswith("...") and cut.endswith("...") and len(cut.split()) == 200 and f"{s}нiт{e}" in cut
    assert show("a*", "d").terms == ["аа", "ав"]


@pytest.mark.parametrize("snippet, terms", [("{a}x{b}{a}y{b}", ["x", "y"]), ("{a}x{b} {a}x{b}", ["x"]), ("{a} {b}", []), ("{a}x", []), ("x{b}", []), ("", []), ("{a}x{a}y{b}", ["x{a}y"])])
def test_terms_of_marks(spark, snippet, terms):
    fill = lambda x: x.format(a=T.MARK_START, b=T.MARK_END)
    got = spark.createDataFrame([(fill(snippet),)], "s string").select(T.snippet_terms(F.col("s"))).head()[0]
    assert got == [fill(t) for t in terms]


def test_written_index_gives_the_same(spark, corpus, tmp_path):
    pages, docs, _ = corpus
    again = search.write_index(pages, str(tmp_path / "index"))
    assert search.search(again, docs, "alpha NOT beta").collect() == search.search(pages, docs, "alpha NOT beta").collect()


def test_postings(corpus):
    pages, _, _ = corpus
    p = search.postings(pages)
    assert p.agg(F.sum("tf")).head()[0] == pages.agg(F.sum(F.size("tokens"))).head()[0]
    assert p.filter(F.size("positions") != F.col("tf")).isEmpty()


@pytest.mark.parametrize("query", ["alpha", "alph*", '"alpha beta"', "alpha NOT beta", "(alpha OR beta) AND (gamma OR delta)", "EC-423-1", 'alpha AND ""', 'alpha beta NOT gam* OR delta AND "beta alph" OR корпус', "alpha alpha"])
def test_postings_give_what_pages_give(spark, corpus, tmp_path_factory, query):
    pages, docs, _ = corpus
    path = str(tmp_path_factory.getbasetemp() / "postings")
    if not (tmp_path_factory.getbasetemp() / "postings").exists():
        search.write_postings(pages, path)
    plain = lambda df: sorted((r.doc_id, r.page_number, round(r.score, 9)) for r in df.collect())
    assert plain(search.matching_postings(spark, path, query)) == plain(search.matching_pages(pages, query))


def test_postings_reach_the_scan_by_term(spark, corpus, tmp_path, capsys):
    pages, docs, _ = corpus
    search.write_postings(pages, str(tmp_path))
    hits = search.matching_postings(spark, str(tmp_path), "alpha OR gam*")
    hits.explain("formatted")
    assert "PushedFilters: [Or(StringStartsWith(term,gam),EqualTo(term,alpha))]" in capsys.readouterr().out.replace("Or(EqualTo(term,alpha),StringStartsWith(term,gam))", "Or(StringStartsWith(term,gam),EqualTo(term,alpha))").replace("In(term, [alpha])", "EqualTo(term,alpha)")
    ranked = search.rank(hits, docs).orderBy("score", "doc_id").limit(5).collect()
    assert ranked == search.search(pages, docs, "alpha OR gam*", limit=5).collect()
    with pytest.raises(ValueError):
        search.matching_postings(spark, str(tmp_path), " ")


def test_search_with_count(corpus):
    pages, docs, _ = corpus
    rows = search.search_with_count(pages, docs, "alpha", limit=4, offset=2).collect()
    assert [r[:4] for r in rows] == [tuple(r) for r in search.search(pages, docs, "alpha", limit=4, offset=2).collect()]
    assert {r.n_docs for r in rows} == {search.count(pages, docs, "alpha").head().n_docs}
    assert {r.n_docs for r in search.search_with_count(pages, docs, "", limit=3).collect()} == {30}


def test_snippet_of_a_long_page_takes_linear_time(spark):
    words = [f"w{i}" for i in range(20_000)]
    words[15_000] = "the"
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    began = time.monotonic()
    row = search.page_hits(tables.index_pages(tables.page_lines(docs)), 'the OR "of the"', [1]).select(F.translate("snippet", "абекмнорстух", "abekmhopctyx").alias("s"), "terms").head()
    assert time.monotonic() - began < 20 and row.s.startswith("...w14901 ") and row.s.endswith(" w15100...") and len(row.terms) == 1
