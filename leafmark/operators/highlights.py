"""Search for terms among the word boxes of pages, and diagnosis of turned coordinates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.functions.text import normalize_text
from leafmark.operators.filters import check_request

PAGE = ("doc_id", "page_number")
#: Share of boxes outside the page, share of upright boxes, and how much longer one side must be.
OUTSIDE, UPRIGHT, ASPECT = 0.05, 0.7, 2.0


def diagnose(boxes: DataFrame) -> DataFrame:
    """(doc_id, page_number, n_words, outside, upright, flip, confidence): boxes beyond the page and upright boxes both hint at turned text."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    out = (F.col("x0") < 0) | (F.col("x1") > F.col("page_width")) | (F.col("y0") < 0) | (F.col("y1") > F.col("page_height"))
    tall = (h > 0) & (h > w * ASPECT)
    wide = ~tall & (w > 0) & (w > h * ASPECT)
    n = lambda c: F.sum(c.cast("long"))
    d = boxes.groupBy(*PAGE).agg(F.count("*").alias("n_words"), n(out).alias("_out"), n(tall).alias("_tall"), n(wide).alias("_wide"))
    d = d.select(*PAGE, "n_words", (F.col("_out") / F.col("n_words")).alias("outside"), F.when(F.col("_tall") + F.col("_wide") > 0, F.col("_tall") / (F.col("_tall") + F.col("_wide"))).otherwise(0.0).alias("upright"))
    one, two = F.col("outside") > OUTSIDE, F.col("upright") > UPRIGHT
    return d.withColumn("flip", one | two).withColumn("confidence", F.when(one & two, "high").when(one | two, "medium").otherwise("none"))


def anomalies(diagnosis: DataFrame) -> DataFrame:
    """Pages whose coordinates are worth an event."""
    return diagnosis.filter(F.col("confidence").isin("high", "medium"))


def turned(x0: Column, y0: Column, x1: Column, y1: Column, height: Column) -> Column:
    """The box of turned text as it is shown, a struct (x0, y0, x1, y1); degenerate boxes stay."""
    bad = (x1 <= x0) | (y1 <= y0)
    s = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    return F.when(bad, s(x0, y0, x1, y1)).otherwise(s(y0, height - x1, y1, height - x0))


def _single(boxes: DataFrame, terms: list[str]) -> DataFrame:
    """Boxes of the terms of one word: one join with the words, however many terms."""
    words = _words(boxes, [(t, 0, t) for t in terms])
    return boxes.join(F.broadcast(words), "normalized").select(*PAGE, "page_width", "page_height", "x0", "y0", "x1", "y1", "term")


def _words(boxes: DataFrame, rows: list[tuple[str, int, str]]) -> DataFrame:
    """(term, place, normalized) of the words of terms; 200 terms of 20 words at most."""
    made = boxes.sparkSession.createDataFrame(rows, "term string, place int, word string")
    return made.select("term", "place", normalize_text(F.col("word")).alias("normalized"))


def _several(boxes: DataFrame, terms: list[str]) -> DataFrame:
    """Places of the terms of several words: boxes meet the words that they may be, and those of one start and term are counted."""
    words = _words(boxes, [(t, i, w) for t in terms for i, w in enumerate(t.split())])
    sizes = boxes.sparkSession.createDataFrame([(t, len(t.split())) for t in terms], "term string, size int")
    line = [*PAGE, "block_no", "line_no", "page_width", "page_height", "term"]
    met = boxes.join(F.broadcast(words), "normalized").withColumn("begin", F.col("word_no") - F.col("place"))
    side = lambda f, c: f(c).alias(c)
    spans = met.groupBy(*line, "begin").agg(F.countDistinct("place").alias("n"), side(F.min, "x0"), side(F.min, "y0"), side(F.max, "x1"), side(F.max, "y1"))
    return spans.join(F.broadcast(sizes), "term").filter("n = size").select(*PAGE, "page_width", "page_height", "x0", "y0", "x1", "y1", "term")


def highlights(boxes: DataFrame, terms: list[str], turn: bool | None = None, diagnostics: bool = True) -> DataFrame:
    """(doc_id, page_number, term, x, y, w, h, flip, confidence): places of terms as shares of the page.

    A word matches boxes of its normalised form; several match words in a row
    of one line. ``turn`` None asks the diagnosis (if on), True and False are
    taken as given with confidence ``manual``. Pages without size have no places;
    a term that is listed twice counts once. ValueError for too many or too long terms.
    """
    check_request(1, 0, terms)
    terms = list(dict.fromkeys(t.strip() for t in terms if t and t.strip()))
    boxes = boxes.filter((F.col("page_width") > 0) & (F.col("page_height") > 0))
    if not terms:
        terms, boxes = ["-"], boxes.limit(0)
    kinds = (_single, [t for t in terms if len(t.split()) == 1]), (_several, [t for t in terms if len(t.split()) > 1])
    found = reduce(DataFrame.unionByName, [kind(boxes, own) for kind, own in kinds if own])
    if turn is None and diagnostics:
        found = found.join(diagnose(boxes).select(*PAGE, "flip", "confidence"), list(PAGE))
    else:
        found = found.withColumn("flip", F.lit(bool(turn))).withColumn("confidence", F.lit("none" if turn is None else "manual"))
    plain = F.struct("x0", "y0", "x1", "y1")
    box = F.when(F.col("flip"), turned(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("page_height"))).otherwise(plain)
    b = found.withColumn("_b", box)
    w, h = F.col("page_width"), F.col("page_height")
    return b.select(*PAGE, "term", (F.col("_b.x0") / w).alias("x"), (F.col("_b.y0") / h).alias("y"), ((F.col("_b.x1") - F.col("_b.x0")) / w).alias("w"), ((F.col("_b.y1") - F.col("_b.y0")) / h).alias("h"), "flip", "confidence")


def index_by_term(boxes: DataFrame) -> DataFrame:
    """(doc_id, page_number, normalized, n, first_word): the places of each word of a page."""
    return boxes.groupBy(*PAGE, "normalized").agg(F.count("*").alias("n"), F.min(F.struct("line_no", "word_no"))["word_no"].alias("first_word"))
