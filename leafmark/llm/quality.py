"""Quality rules: base counts of a text, and robust multivariate outliers.

Every language and source gets a minimum-covariance-determinant estimate of its
transformed statistics: concentration steps keep the share ``core`` of rows
with the smallest Mahalanobis distances and estimate mean and covariance anew.
Where they begin is searched on a hashed sample of each group, from many starts,
of which the least determinant wins; all rows then go through the steps until
they change nothing. An estimate is drawn towards that of its language, which
counts as ``prior`` rows, and this towards the whole table's, so the few rows of
a small group are judged as well.

A step is two aggregations over the table of statistics. The order statistic it
needs comes from a histogram of the distances with logarithmic bins, so no
group is ever sorted or gathered, however large. Moments are sums of
fixed-point integers, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.llm import scratch
from leafmark.llm.joins import with_groups
from leafmark.llm.words import SPACE, word_array

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Bins of a distance: this many for each doubling.
PER_OCTAVE = 64
#: Fixed-point unit of the statistics' moments.
UNIT = 1 << 16
#: Between the language and the source in the name of a group.
PART = "\x1f"
STATS = ("z_length", "z_word", "z_symbols", "z_lines", "z_repeats", "z_capitals")


@dataclass(frozen=True)
class Outliers:
    """``core``: share of rows that estimates rest on; ``prior``: rows that the estimate of a group's language counts as, and to this the whole table's.

    ``cut`` is a squared distance in units of the core's covariance scaled to
    a normal distribution; 0.75 of such rows lie below 7.84. ``floor`` is added
    to every variance, so a statistic that never varies in a group can't reject.

    About ``sample`` rows of a group choose among ``starts`` small subsets, the
    medians and the classical moments: each gets ``steps`` steps, and the least
    determinant goes on. Steps over all rows end when no log-determinant moves by
    more than ``still``, after ``most`` at the latest.
    """

    core: float = 0.75
    steps: int = 3
    prior: float = 30.0
    cut: float = 100.0
    floor: float = 0.02
    sample: int = 256
    starts: int = 8
    still: float = 0.05
    most: int = 20


def window_hashes(words: Column) -> Column:
    """Hashes of the 3-word windows of an array of words."""
    n = F.size(words) - 2
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))


#: Bits of a position that are packed below the upper bits of a window's hash.
PLACE_BITS = 24


def repeated_places(packed: Column, hashes: Column) -> Column:
    """Sorted places of the windows that a text holds twice or more.

    ``packed`` is the sorted upper bits of each hash with the window's place
    below. Neighbours with the same upper bits have the same hash, or else, and in
    texts with more windows than a place can name, whole hashes and places are
    sorted together.
    """
    same = lambda k, p: F.coalesce(F.shiftright(F.get(packed, k), PLACE_BITS) == F.shiftright(p, PLACE_BITS), F.lit(False))
    place = lambda p: p.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    twice = F.filter(packed, lambda p, k: same(k - 1, p) | same(k + 1, p))
    unlike = F.exists(F.transform(packed, lambda p, k: same(k - 1, p) & (F.get(hashes, place(F.get(packed, k - 1))) != F.get(hashes, place(p)))), lambda x: x)
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    like = lambda k, p: F.get(pairs, k)["h"].eqNullSafe(p["h"])
    slow = F.transform(F.filter(pairs, lambda p, k: like(k - 1, p) | like(k + 1, p)), lambda p: p["i"])
    return F.sort_array(F.when((F.size(hashes) > 1 << PLACE_BITS) | unlike, slow).otherwise(F.transform(twice, place)))


def counts(docs: DataFrame, text: str) -> DataFrame:
    """The column ``rest`` of ``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_capitals (long) of the column ``text``.

    A null text has none of anything. Windows are compared by 64-bit hashes.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACE}]")))
    d = docs.select("rest", t.alias("t"), word_array(t).alias("w"), lines.alias("l"))
    done = ["rest", "n_words", "word_chars", "n_symbols", "n_capitals", "n_dup_lines"]
    d = d.select(
        "rest", F.size("w").cast("long").alias("n_words"), F.length(F.translate("t", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), window_hashes(F.col("w")).alias("h"),
    )
    upper = F.lit(-1 << PLACE_BITS)
    d = d.select(*done, "h", F.sort_array(F.transform("h", lambda h, i: h.bitwiseAND(upper).bitwiseOR(i.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("long")))).alias("p"))
    d = d.select(*done, repeated_places(F.col("p"), F.col("h")).alias("at"))
    # the words from a place up to the next one, three at most
    covered = F.aggregate(F.transform("at", lambda i, k: F.least(F.lit(3), F.coalesce(F.get(F.col("at"), k + 1) - i, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select(*done, covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def transformed() -> list[Column]:
    """Statistics on scales on which prose is roughly normal: logarithms of sizes, square roots of shares."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda x: F.sqrt(x / n)
    z = (F.log(n.cast("double")) / 2, 4 * F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), 3 * share(F.col("n_symbols")), 3 * share(F.col("n_dup_lines")), share(F.col("n_repeat_words")), 3 * F.sqrt(F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1))))
    return [F.round(x, 6).alias(name) for x, name in zip(z, STATS)]


def core_scale(core: float) -> float:
    """What makes the covariance of the core that of normal statistics: core / P(chi2 of p + 2 degrees < the core's quantile of chi2 of p), for an even number p."""
    p = len(STATS)
    below = lambda x, degrees: 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))
    if core >= 1:
        return 1.0
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle, p) < core else (low, middle)
    return core / below(low, p + 2)


CELLS = [f"{i}{j}" for i in range(len(STATS)) for j in range(i + 1)]


def _sums(rows: DataFrame) -> DataFrame:
    """Of each ``_g``: number of rows, sums s0.. of the statistics and s00, s10, .. of their products."""
    p, half = len(STATS), 30
    fixed = [F.round(F.col(s) * UNIT).cast("long") for s in STATS]
    # a product's upper and lower bits are summed apart: sums of longs depend on no order and are compiled
    halves = {f"{i}{j}": fixed[i] * fixed[j] for i in range(p) for j in range(i + 1)}
    upper = [F.sum(F.shiftright(x, half)).alias(f"u{c}") for c, x in halves.items()]
    lower = [F.sum(x.bitwiseAND(F.lit((1 << half) - 1))).alias(f"v{c}") for c, x in halves.items()]
    g = rows.groupBy("_g").agg(F.count("*").cast("double").alias("_n"), *(F.sum(x).alias(f"t{i}") for i, x in enumerate(fixed)), *upper, *lower)
    single = [(F.col(f"t{i}") / UNIT).alias(f"s{i}") for i in range(p)]
    return g.select("_g", "_n", *single, *(((F.col(f"u{c}") * float(1 << half) + F.col(f"v{c}")) / UNIT**2).alias(f"s{c}") for c in CELLS))


def _moments(sums: DataFrame, key: str) -> DataFrame:
    """Means m0.. and covariances c00, c10, .. of sums, and their number of rows."""
    mean = [(F.col(f"s{i}") / F.col("_n")).alias(f"m{i}") for i in range(len(STATS))]
    cov = [(F.col(f"s{c}") / F.col("_n") - F.col(f"s{c[0]}") / F.col("_n") * F.col(f"s{c[1]}") / F.col("_n")).alias(f"c{c}") for c in CELLS]
    return sums.select(key, "_n", *mean, *cov)


def _drawn(own: DataFrame, parent: DataFrame, key: str, prior: float) -> DataFrame:
    """Moments ``own`` drawn towards those of ``parent``, whose columns end in ``_``."""
    names = [*(f"m{i}" for i in range(len(STATS))), *(f"c{c}" for c in CELLS)]
    both = own.join(parent, key)
    return both.select(*own.columns[:-len(names)], *(((F.col("_n") * F.col(x) + prior * F.col(f"{x}_")) / (F.col("_n") + prior)).alias(x) for x in names))


def _shrunk(rows: DataFrame, how: Outliers) -> DataFrame:
    """Moments of each ``_g``, drawn towards those of its language, and these towards the whole table's."""
    sums = scratch.store(_sums(rows).withColumn("_lang", F.substring_index("_g", PART, 1)), "sums")
    names = [c for c in sums.columns if c not in ("_g", "_lang")]
    add = lambda x, *key: x.groupBy(*key).agg(*(F.sum(c).alias(c) for c in names))
    renamed = lambda x, key: x.select(key, *(F.col(c).alias(f"{c}_") for c in x.columns if c not in (key, "_n")))
    languages = add(sums, "_lang")
    table = renamed(_moments(add(sums, F.lit(0).alias("_all")), "_all"), "_all")
    languages = _drawn(_moments(languages, "_lang").withColumn("_all", F.lit(0)).select("_lang", "_all", "_n", *(f"m{i}" for i in range(len(STATS))), *(f"c{c}" for c in CELLS)), table, "_all", how.prior).drop("_all")
    own = _moments(sums, "_g").withColumn("_lang", F.substring_index("_g", PART, 1))
    own = own.select("_g", "_lang", "_n", *(f"m{i}" for i in range(len(STATS))), *(f"c{c}" for c in CELLS))
    return _drawn(own, renamed(languages, "_lang"), "_lang", how.prior).drop("_lang", "_n")


def _factor(m: DataFrame, scale: float, floor: float) -> DataFrame:
    """Means and the Cholesky factors of the covariances: l00, l10, ..; an inner select for each column."""
    p = len(STATS)
    for j in range(p):
        col = {i: F.col(f"c{i}{j}") * scale + (floor if i == j else 0.0) for i in range(j, p)}
        for k in range(j):
            col = {i: x - F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for i, x in col.items()}
        m = m.withColumn(f"l{j}{j}", F.sqrt(F.greatest(col[j], F.lit(floor / 10))))
        m = m.withColumns({f"l{i}{j}": col[i] / F.col(f"l{j}{j}") for i in range(j + 1, p)})
    return m.select("_g", *(f"m{i}" for i in range(p)), *(f"l{c}" for c in CELLS))


def _distances(rows: DataFrame, estimates: DataFrame, groups: int) -> DataFrame:
    """``rows`` with ``_d2``, the squared Mahalanobis distance, by forward substitution."""
    d = with_groups(rows, estimates, "_g", groups, "_id")
    for i, s in enumerate(STATS):
        x = F.col(s) - F.col(f"m{i}")
        for k in range(i):
            x = x - F.col(f"l{i}{k}") * F.col(f"_y{k}")
        d = d.withColumn(f"_y{i}", x / F.col(f"l{i}{i}"))
    total = sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(len(STATS))), F.lit(0.0))
    return d.select(*rows.columns, F.round(total, 6).alias("_d2"))


def _bin(d2: Column) -> Column:
    return F.round(F.log2(d2 + 2.0**-20) * PER_OCTAVE).cast("int")


def _log_det() -> Column:
    return sum((2 * F.log(f"l{i}{i}") for i in range(len(STATS))), F.lit(0.0))


def _starts(rows: DataFrame, how: Outliers, groups: int) -> DataFrame:
    """Of every ``_g``, the estimate with the least determinant that a start leads to on a sample by hash: small groups whole, others about ``how.sample`` rows."""
    sizes = scratch.store(rows.groupBy("_g").agg(F.count("*").alias("_size")), "sizes")
    hashed = with_groups(rows.withColumn("_h", F.xxhash64("_id", *STATS)), sizes, "_g", groups, "_id")
    drawn = scratch.store(hashed.filter(F.pmod("_h", F.lit(1 << 30)) * F.col("_size") < F.lit(how.sample << 30)).select(*rows.columns), "sample")
    # start 0 is the classical moments, 1 the medians, the others are subsets of one row more than there are statistics
    named = lambda k: F.concat("_g", F.lit("\x1e"), k)
    tried = drawn.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(how.starts + 1)))).withColumn("_g", named(F.col("_k").cast("string")))
    chance = Window.partitionBy("_g").orderBy(F.xxhash64("_id", "_k", *STATS), "_id")
    few = tried.filter("_k > 1").withColumn("_n", F.row_number().over(chance)).filter(F.col("_n") <= len(STATS) + 1)
    begun = few.select(*rows.columns).unionAll(tried.filter("_k = 0").select(*rows.columns))
    first = _factor(_moments(scratch.store(_sums(begun), "sums"), "_g"), 1.0, how.floor)
    middle = scratch.store(drawn.groupBy("_g").agg(*(F.percentile(c, F.lit(0.5)).alias(f"m{i}") for i, c in enumerate(STATS))), "medians")
    off = with_groups(drawn, middle, "_g", groups, "_id").groupBy("_g").agg(*(F.first(f"m{i}").alias(f"m{i}") for i in range(len(STATS))), *(F.percentile(F.abs(F.col(c) - F.col(f"m{i}")), F.lit(0.5)).alias(f"a{i}") for i, c in enumerate(STATS)))
    factor = [(F.sqrt(F.pow(1.4826 * F.col(f"a{i}"), F.lit(2.0)) + how.floor) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(len(STATS)) for j in range(i + 1)]
    robust = off.select(named(F.lit("1")).alias("_g"), *(f"m{i}" for i in range(len(STATS))), *factor)
    now = scratch.store(first.unionByName(robust), "starts")
    tried = scratch.store(tried.select(*rows.columns), "tried")
    for _ in range(how.steps):
        now = _step(tried, now, how, groups * (how.starts + 2), lambda core: _moments(scratch.store(_sums(core), "sums"), "_g"))
    names = [c for c in now.columns if c != "_g"]
    best = now.groupBy(F.regexp_replace("_g", "\x1e[0-9]+$", "").alias("_group")).agg(F.min_by(F.struct(*names), F.struct(F.round(_log_det(), 6), "_g")).alias("_best"))
    return best.select(F.col("_group").alias("_g"), "_best.*")


def _step(rows: DataFrame, now: DataFrame, how: Outliers, groups: int, moments: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Estimates, by ``moments``, of the rows up to the bin of distances that holds the core's order statistic."""
    d = _distances(rows, now, groups).withColumn("_b", _bin(F.col("_d2")))
    hist = d.groupBy("_g", "_b").agg(F.count("*").alias("_n"))
    up_to = F.sum("_n").over(Window.partitionBy("_g").orderBy("_b"))
    whole = F.sum("_n").over(Window.partitionBy("_g"))
    cut = hist.select("_g", "_b", up_to.alias("_c"), whole.alias("_all")).filter(F.col("_c") >= F.ceil(F.col("_all") * how.core)).groupBy("_g").agg(F.min("_b").alias("_cut"))
    core = with_groups(d, scratch.store(cut, "cuts"), "_g", groups, "_id").filter(F.col("_b") <= F.col("_cut"))
    return scratch.store(_factor(moments(core), core_scale(how.core), how.floor), "estimates")


def _moved(now: DataFrame, last: DataFrame) -> float:
    """The largest change of a group's log-determinant."""
    both = now.select("_g", _log_det().alias("a")).join(last.select("_g", _log_det().alias("b")), "_g")
    return both.agg(F.max(F.abs(F.col("a") - F.col("b")))).head()[0] or 0.0


def estimates(rows: DataFrame, how: Outliers, groups: int) -> DataFrame:
    """An MCD estimate for every ``_g`` of ``rows`` (the statistics): steps over all rows from the best start of a sample."""
    now = scratch.store(_starts(rows, how, groups), "estimates")
    for _ in range(how.most):
        last, now = now, _step(rows, now, how, groups, lambda core: _shrunk(core, how))
        if _moved(now, last) <= how.still:
            break
    return now


#: Columns that ``judge`` adds.
JUDGED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "base_failed", "d2", "kept")


def judge(docs: DataFrame, text: str = "text", how: Outliers = Outliers()) -> DataFrame:
    """``docs`` (``text``, lang, source and any others) without ``text``, with the columns JUDGED.

    ``kept`` is false if the base rule fails or the squared distance ``d2`` is
    over ``how.cut``. Rows that fail the base rule, such as null and empty texts,
    take no part in estimates and have a null d2. Null languages and sources are
    values of their own. Rows that repeat count each. Columns named like the new
    ones, in any case, are replaced; others keep their names whatever these are.
    An empty table gives an empty table.
    """
    rest = [c for c in docs.columns if c != text and c.lower() not in JUDGED]
    named = F.concat_ws(PART, F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    packed = docs.select(F.struct(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), named.alias("group")).alias("rest"), F.col(f"`{text}`").alias("text"))
    counted = counts(packed, "text").withColumn("_id", F.monotonically_increasing_id()).withColumn("base_failed", base_failed())
    counted = scratch.store(counted.select("rest.row", F.col("rest.group").alias("_g"), *(c for c in counted.columns if c != "rest")), "counts")
    rows = scratch.store(counted.filter(~F.col("base_failed")).select("_id", "_g", *transformed()), "statistics")
    groups = rows.select("_g").distinct().count()
    far = _distances(rows, estimates(rows, how, groups), groups).select("_id", F.col("_d2").alias("d2"))
    out = counted.join(far, "_id", "left").withColumn("kept", ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= how.cut))
    return out.select(*(F.col("row").getField(c).alias(c) for c in rest), *JUDGED)


def op4_robust_outliers(spark, sf_dir: str) -> DataFrame:
    """Base counts and the verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")
