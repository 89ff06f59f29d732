import pytest

from leafmark import schemas
from leafmark.operators import highlights


def boxes(spark, *rows):
    """Rows (x0, y0, x1, y1, word, line_no, word_no) of one page, 100 wide and 200 high."""
    return spark.createDataFrame([("d", 0, *map(float, r[:4]), r[4], r[4].lower(), 0, r[5], r[6], 100.0, 200.0) for r in rows], schemas.WORD_BOXES)


def places(df):
    return [(r.term, *(round(v, 4) for v in (r.x, r.y, r.w, r.h)), r.flip, r.confidence) for r in df.collect()]


@pytest.fixture(scope="module")
def page(spark):
    return boxes(spark, (10, 20, 30, 25, "alpha", 0, 0), (35, 20, 55, 25, "beta", 0, 1), (60, 20, 80, 25, "beta", 0, 3))


@pytest.mark.parametrize(
    "turn, diagnostics, want",
    [(True, True, ("Alpha", 0.2, 0.85, 0.05, 0.1, True, "manual")), (False, True, ("Alpha", 0.1, 0.1, 0.2, 0.025, False, "manual")), (None, True, ("Alpha", 0.1, 0.1, 0.2, 0.025, False, "none")), (None, False, ("Alpha", 0.1, 0.1, 0.2, 0.025, False, "none"))],
)
def test_single_word(page, turn, diagnostics, want):
    assert places(highlights.highlights(page, [" Alpha ", ""], turn, diagnostics)) == [want]


def test_phrase_needs_neighbours(page):
    assert places(highlights.highlights(page, ["ALPHA beta"], True)) == [("ALPHA beta", 0.2, 0.725, 0.05, 0.225, True, "manual")]
    assert places(highlights.highlights(page, ["beta beta"])) == []
    assert places(highlights.highlights(page, [])) == []


def test_diagnosis(spark):
    tall = [(10, 10 + 30 * i, 15, 35 + 30 * i, "w", i, 0) for i in range(4)]
    one = lambda *rows: highlights.diagnose(boxes(spark, *rows)).head()
    assert one(*tall)[3:] == (0.0, 1.0, True, "medium")
    assert one(*tall, (90, 0, 120, 10, "w", 9, 0))[3:] == (0.2, 0.8, True, "high")
    assert one((0, 0, 100, 10, "w", 0, 0))[3:] == (0.0, 0.0, False, "none")
    assert one((-1, 0, 5, 5, "w", 0, 0))[3:] == (1.0, 0.0, True, "medium")
    assert highlights.anomalies(highlights.diagnose(boxes(spark, *tall))).count() == 1


def test_degenerate_pages(spark, page):
    none = page.withColumn("page_width", page.page_width * 0)
    assert highlights.highlights(none, ["alpha"]).isEmpty()
    flat = boxes(spark, (10, 20, 10, 25, "alpha", 0, 0))
    assert places(highlights.highlights(flat, ["alpha"], True)) == [("alpha", 0.1, 0.1, 0.0, 0.025, True, "manual")]


def test_index_by_term(page):
    assert sorted((r.normalized, r.n, r.first_word) for r in highlights.index_by_term(page).collect()) == [("alpha", 1, 0), ("beta", 2, 1)]
