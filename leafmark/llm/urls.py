"""URL filters: rules on host and path, and boosted trees for URLs that no rule fits.

The URLs that rules decide are the labelled ones. Lexical features are counted
into small integer bins, so a level of a tree needs one aggregation: sums of
gradients by node, feature and bin, at most ``2**depth * features * BINS`` rows,
from which the driver picks the splits. Trees are ``CASE`` expressions. All sums
are of fixed-point integers, so reruns grow the same trees.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.llm import samples, scratch
from leafmark.llm.joins import with_groups

BINS = 64
#: Bins of gradients: 2**-20.
FIXED = 1 << 20
#: Rules as verdict and host/path; a host fits itself and its subdomains, a path what starts with it; the longest wins.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("f_length", "f_path", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params", "f_hyphens", "f_suffix_count", "f_suffix_rate")


@dataclass(frozen=True)
class Training:
    """``rows``: different labelled URLs that the trees see at most, those with the smallest hashes."""

    rows: int = 20_000
    trees: int = 10
    depth: int = 3
    rate: float = 0.3
    ridge: float = 1.0
    prior: float = 50.0


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits as a struct (rule, verdict), else null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda x: len(x[1])):
        name, slash, prefix = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + prefix))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _bin(x: Column) -> Column:
    return F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(BINS - 1)).cast("int")


def entropy(text: Column) -> Column:
    """Bits a character; 0 for an empty text."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.array_sort(F.array_distinct(F.split(text, ""))), F.lit(0.0), lambda acc, c: F.when(c == "", acc).otherwise(acc - share(c) * F.log2(share(c))))


def lexical(pages: DataFrame, key: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Key, host, path, rule, verdict of the rule, suffix and the binned features of the URL alone."""
    host, path = split_url(F.col("url"))
    p = pages.select(F.col(key), F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    p = p.withColumn("_rule", matched(F.col("host"), F.col("path"), rules))
    u = F.col("url")
    return p.select(
        key, "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("ruled"),
        F.regexp_extract("host", r"[^.]*$", 0).alias("suffix"), F.xxhash64(u).alias("_h"),
        _bin(F.length(u) / 4).alias("f_length"), _bin(F.length("path") / 2).alias("f_path"), _bin(_count(F.col("path"), "/")).alias("f_depth"),
        _bin(_count(F.col("host"), ".")).alias("f_labels"), _bin(_count(u, "0123456789") * 128 / F.greatest(F.length(u), F.lit(1))).alias("f_digits"),
        _bin(entropy(u) * 10).alias("f_entropy"), _bin(_count(u, "&?")).alias("f_params"), _bin(_count(F.col("host"), "-")).alias("f_hyphens"),
    )


def suffix_statistics(lex: DataFrame, prior: float) -> DataFrame:
    """Suffix with its binned row count and its smoothed share of blocked URLs.

    The share is over the labelled URLs with odd hashes; the trees learn from
    the even ones, so no URL's own label reaches its features. One row a suffix; their
    number decides how the URLs are joined.
    """
    odd = (F.col("_h") % 2 != 0) & F.col("ruled").isNotNull()
    g = lex.groupBy("suffix").agg(F.count("*").alias("n"), F.sum(odd.cast("long")).alias("seen"), F.sum((odd & (F.col("ruled") == "block")).cast("long")).alias("bad"))
    return g.select("suffix", _bin(F.log2("n") * 2).alias("f_suffix_count"), _bin((F.col("bad") + prior / 2) / (F.col("seen") + prior) * (BINS - 1)).alias("f_suffix_rate"))


@dataclass
class Node:
    """A split on ``bin <= at`` of a feature, or a leaf with a value."""

    value: float = 0.0
    feature: str = ""
    at: int = 0
    low: Node | None = None
    high: Node | None = None

    def column(self) -> Column:
        if self.low is None:
            return F.lit(self.value)
        return F.when(F.col(self.feature) <= self.at, self.low.column()).otherwise(self.high.column())


def margin(start: float, trees: Sequence[Node]) -> Column:
    return reduce(lambda a, t: a + t.column(), trees, F.lit(start))


def _node_ids(root: Node) -> tuple[Column, list[Node]]:
    """The number of the leaf that a row is in, and the leaves."""
    leaves: list[Node] = []

    def walk(n: Node) -> Column:
        if n.low is None:
            leaves.append(n)
            return F.lit(len(leaves) - 1)
        low, high = walk(n.low), walk(n.high)
        return F.when(F.col(n.feature) <= n.at, low).otherwise(high)

    return walk(root), leaves


def grow(sample: DataFrame, how: Training) -> tuple[float, list[Node]]:
    """Boosted trees for ``sample`` (features and ``y``), both classes with the same total weight; the start is 0.

    A URL without telling features so scores about 0, however many rules block.
    ``sample`` is bounded by ``how.rows`` and lies in one partition, so the
    aggregations need no shuffle. One class alone gives no trees.
    """
    n, bad = sample.agg(F.count("*"), F.sum("y")).head()
    if not n or not bad or bad == n:
        return (0.0 if not n else 9.0 if bad else -9.0), []
    start, trees = 0.0, []
    weight = F.when(F.col("y") == 1, F.lit(n / (2 * bad))).otherwise(F.lit(n / (2 * (n - bad))))
    for _ in range(how.trees):
        p = 1 / (1 + F.exp(-margin(start, trees)))
        root = Node()
        for level in range(how.depth + 1):
            ids, leaves = _node_ids(root)
            rows = sample.select(ids.alias("node"), F.round(weight * (p - F.col("y")) * FIXED).cast("long").alias("g"), F.round(weight * p * (1 - p) * FIXED).cast("long").alias("h"), *FEATURES)
            if level == how.depth:
                sums = {r[0]: r[1:] for r in rows.groupBy("node").agg(F.sum("g"), F.sum("h")).collect()}
                for i, leaf in enumerate(leaves):
                    g, h = sums.get(i, (0, 0))
                    leaf.value = round(-how.rate * (g / FIXED) / (h / FIXED + how.ridge), 9)
                break
            hist = rows.select("node", "g", "h", F.posexplode(F.array(*FEATURES)).alias("feature", "bin")).groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            cells: dict[int, dict[int, dict[int, tuple[int, int]]]] = {}
            for r in hist:
                cells.setdefault(r["node"], {}).setdefault(r["feature"], {})[r["bin"]] = (r["g"], r["h"])
            for i, leaf in enumerate(leaves):
                if split := best_split(cells.get(i, {}), how.ridge):
                    leaf.feature, leaf.at = FEATURES[split[0]], split[1]
                    leaf.low, leaf.high = Node(), Node()
        trees.append(root)
    return start, trees


def best_split(features: dict[int, dict[int, tuple[int, int]]], ridge: float, least: float = 1.0) -> tuple[int, int] | None:
    """Feature and bin with the largest gain; ties go to the first. None if no split gains or leaves curvature ``least`` on both sides."""
    score = lambda g, h: (g / FIXED) ** 2 / (h / FIXED + ridge)
    best, out = 1e-6, None
    for f in sorted(features):
        bins = sorted(features[f].items())
        whole_g, whole_h = sum(g for _, (g, _) in bins), sum(h for _, (_, h) in bins)
        g = h = 0
        for b, (dg, dh) in bins[:-1]:
            g, h = g + dg, h + dh
            if min(h, whole_h - h) >= least * FIXED and (gain := score(g, h) + score(whole_g - g, whole_h - h) - score(whole_g, whole_h)) > best:
                best, out = gain, (f, b)
    return out


def judge(pages: DataFrame, key: str = "page_id", rules: Sequence[tuple[str, str]] = RULES, how: Training = Training()) -> DataFrame:
    """Key, host, path, rule, verdict (``allow`` or ``block``) and score of every URL.

    A rule decides where one fits; else the trees do, by the sign of the score
    (the log-odds of ``block``). Null URLs have empty host and path. Without
    labelled URLs every score is 0 and the verdict ``allow``. Other columns of
    ``pages`` are left out; repeated rows stay; an empty table gives an empty table.
    """
    lex = scratch.store(lexical(pages, key, rules), "lexical")
    stats = scratch.store(suffix_statistics(lex, how.prior), "suffixes")
    full = with_groups(lex, stats, "suffix", stats.count(), key)
    labelled = full.filter(F.col("ruled").isNotNull() & (F.col("_h") % 2 == 0)).select("_h", (F.col("ruled") == "block").cast("int").alias("y"), *FEATURES)
    # a threshold on the hash leaves little more than the sample before anything is sorted; a URL counts once
    different = labelled.agg(F.approx_count_distinct("_h", 0.02)).head()[0]
    few = samples.by_hash(labelled, F.col("_h"), different, 1.2 * how.rows).distinct()
    sample = scratch.store(few.orderBy(F.xxhash64("_h"), "_h", "y", *FEATURES).limit(how.rows), "sample").coalesce(1)
    score = margin(*grow(sample, how))
    return full.select(key, "host", "path", "rule", F.coalesce("ruled", F.when(score > 0, "block").otherwise("allow")).alias("verdict"), F.round(score, 6).alias("score"))


def op2_gradient_boosted_urls(spark, sf_dir: str) -> DataFrame:
    """A verdict for the url of every page."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
