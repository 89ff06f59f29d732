"""A search index that changes: segments of postings, a term dictionary, and top-k search that reads the best postings first.

Each upsert is a segment of its own (see ``sources.versions``): the pages, the
postings of their terms sorted by term and *tier*, and the dictionary. A tier is
a class of postings by the share of the score that frequency and length give;
the dictionary knows how many postings a term has in each and the largest share. What an upsert or delete takes away is counted into the
dictionary and the totals with a minus, so scores are those of an index that
was built anew.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.operators import filters as Filter
from leafmark.operators import search
from leafmark.plans import compile as C
from leafmark.plans.query import Leaf, Node, Not, parse
from leafmark.sources.versions import GONE, Part, Versions

#: Classes of postings, postings that a first round reads for each wanted document, those that rounds may look up, lists that are read whole, and segments of a size before they are merged.
TIERS, ROUND, LOOKED_UP, SMALL, FAN = 64, 4, 20_000, 1 << 18, 4


def _share(tf: Column | float, dl: Column | float, mean: float) -> Column | float:
    """What frequency and length give of a score, between 0 and 1."""
    return tf / (tf + C.K1 * (1 - C.B + C.B * dl / mean))


def _grouped(pages: DataFrame) -> DataFrame:
    """(term, doc_id, page_number, dl, tf, positions) of a page table, dealt by range of (term, doc_id): the one shuffle of a segment."""
    rows = pages.select("doc_id", "page_number", "dl", F.posexplode("tokens").alias("position", "term")).repartitionByRange("term", "doc_id")
    grouped = rows.groupBy("term", "doc_id", "page_number").agg(F.max("dl").alias("dl"), F.sort_array(F.collect_list("position")).alias("positions"))
    return grouped.select("term", "doc_id", "page_number", "dl", F.size("positions").alias("tf"), "positions")


def _tiered(rows: DataFrame, mean: float) -> DataFrame:
    """Postings with their tiers, in order within each file; a frequent term is in many."""
    tier = F.floor(_share(F.col("tf"), F.col("dl"), mean) * TIERS).cast("int")
    tiered = rows.select("term", tier.alias("tier"), "doc_id", "page_number", "dl", "tf", "positions")
    return tiered.sortWithinPartitions("term", F.desc("tier"), "doc_id", "page_number")


def _counts(postings: DataFrame, mean: float) -> DataFrame:
    """The dictionary of postings: (term, tier, df, cf, most, mean), ``most`` the largest share when pages have the mean length ``mean``."""
    most = F.max(_share(F.col("tf"), F.col("dl"), mean)).alias("most")
    return postings.groupBy("term", "tier").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), most).select("*", F.lit(mean).alias("mean"))


def _correction(rows: DataFrame) -> DataFrame:
    """Dictionary rows that only count: of (term, df, cf)."""
    return rows.select("term", F.lit(-1).alias("tier"), "df", "cf", F.lit(0.0).alias("most"), F.lit(1.0).alias("mean"))


def _bound(most: float, then: float, now: float) -> float:
    """The largest share of a tier when the mean length was ``then`` and is ``now``."""
    return most / (most + (1 - most) * min(1.0, then / now)) if most else 0.0


def _positive(node: Node) -> list[Leaf]:
    """Leaves that add to a score, repeats included."""
    if isinstance(node, Leaf):
        return [node]
    return _positive(node.left) + ([] if isinstance(node, Not) else _positive(node.right))


def _by_tier(rows: list, bound: Callable) -> list[tuple[int, float, int]]:
    """(tier, largest bound, postings) of dictionary rows of one term, best tier first."""
    out: dict[int, tuple[float, int]] = {}
    for r in rows:
        most, n = out.get(r["tier"], (0.0, 0))
        out[r["tier"]] = max(most, bound(r)), n + r["df"]
    return [(tier, *out[tier]) for tier in sorted(out, reverse=True)]


@dataclass(frozen=True)
class Top:
    """The slice, and how many of the postings of its terms were read for it."""

    rows: DataFrame
    read: int
    of: int


@dataclass(frozen=True)
class SearchIndex:
    """An index as of one version."""

    at: Versions

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> SearchIndex:
        return cls(Versions.open(spark, path, version))

    # what changes it

    def upsert(self, pages: DataFrame, doc_ids: DataFrame | None = None) -> SearchIndex:
        """The next version: documents ``doc_ids`` (those of ``pages`` if not given) have these pages and no others."""
        at = self.at
        ids = (pages if doc_ids is None else doc_ids).select("doc_id")
        part = at.write({"pages": pages.sortWithinPartitions("doc_id", "page_number")})
        stored = at.read(part, "pages")
        n, length = stored.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).head()
        mean = length / n if n else 1.0
        _tiered(_grouped(stored), mean).write.parquet(f"{at.path}/{part.name}/postings")
        postings = at.spark.read.parquet(f"{at.path}/{part.name}/postings")
        part.tables["postings"] = postings.schema.json()
        return self._change(part, ids, _counts(postings, mean), n, length)

    def delete(self, doc_ids: DataFrame) -> SearchIndex:
        """The next version without some documents; ids that it doesn't have don't matter."""
        return self._change(self.at.write({}), doc_ids.select("doc_id"), None, 0, 0)

    def _change(self, part: Part, ids: DataFrame, counts: DataFrame | None, n: int, length: int) -> SearchIndex:
        at = self.at
        dead = self.pages() if at.parts else None
        if dead is not None:
            ids.distinct().write.parquet(f"{at.path}/{part.name}/{GONE}")
            part.tables[GONE] = ids.schema.json()
            dead = dead.join(at.read(part, GONE), "doc_id", "left_semi")
            less, shorter = dead.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).head()
            n, length = n - less, length - shorter
            lost = dead.select("doc_id", "page_number", F.explode("tokens").alias("term")).groupBy("term", "doc_id", "page_number").agg(F.count("*").alias("tf"))
            lost = _correction(lost.groupBy("term").agg((-F.count("*")).alias("df"), (-F.sum("tf")).alias("cf")))
            counts = lost if counts is None else counts.unionByName(lost)
        if counts is not None:
            counts.repartitionByRange("term").sortWithinPartitions("term", F.desc("tier")).write.parquet(f"{at.path}/{part.name}/terms")
            part.tables["terms"] = counts.schema.json()
        part.about.update(pages=n, length=length)
        return SearchIndex(at.commit((*at.parts, part)))

    def merge(self, fan: int = FAN) -> tuple[SearchIndex, int]:
        """The next version with the newest segments of like sizes in one, and how many files were rewritten; the same index and 0 if no ``fan`` of them are alike."""
        at = self.at
        sizes = [max(1, p.about["pages"]) for p in at.parts]
        tiers = [int(math.log(s, fan)) for s in sizes]
        for tier in sorted(set(tiers)):
            begin = len(tiers)
            while begin and tiers[begin - 1] <= tier:
                begin -= 1
            if len(tiers) - begin >= fan:
                return self._merged(at.parts[:begin], at.parts[begin:])
        return self, 0

    def _merged(self, older: tuple[Part, ...], newer: tuple[Part, ...]) -> tuple[SearchIndex, int]:
        at = self.at
        alive = {t: at.alive(rows) for t in ("pages", "postings") if (rows := at.raw(t, newer)) is not None}
        files = sum(len(at.read(p, t).inputFiles()) for p in newer for t in p.tables)
        part = at.write({"pages": alive["pages"].sortWithinPartitions("doc_id", "page_number")} if alive else {}, {k: sum(p.about[k] for p in newer) for k in ("pages", "length")}, newer[-1].order)
        total = at.raw("terms", newer).drop("_order")
        if alive:
            mean = at.read(part, "pages").agg(F.avg("dl")).head()[0] or 1.0
            _tiered(alive["postings"].repartitionByRange("term", "doc_id"), mean).write.parquet(f"{at.path}/{part.name}/postings")
            part.tables["postings"] = next(p for p in newer if "postings" in p.tables).tables["postings"]
            own = _counts(at.read(part, "postings"), mean)
            # what the parts counted off documents of older ones stays counted off
            rest = total.select("term", "df", "cf").unionByName(own.select("term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf")))
            total = own.unionByName(_correction(rest.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df != 0 OR cf != 0")))
        extra = {"terms": total.repartitionByRange("term").sortWithinPartitions("term", F.desc("tier"))}
        if older and (gone := at.raw(GONE, newer)) is not None:
            extra[GONE] = gone.select("doc_id").distinct()
        for t, rows in extra.items():
            rows.write.parquet(f"{at.path}/{part.name}/{t}")
            part.tables[t] = rows.schema.json()
        return SearchIndex(at.commit((*older, part))), files

    # what reads it

    def pages(self) -> DataFrame | None:
        """The page table."""
        return self.at.table("pages")

    def totals(self) -> tuple[int, float]:
        """Number of pages and their mean length; the list of the version has both."""
        n = int(sum(p.about["pages"] for p in self.at.parts))
        return n, (sum(p.about["length"] for p in self.at.parts) / n if n else 0.0)

    def terms(self, prefix: str | None = None) -> DataFrame:
        """(term, df, cf): the dictionary, or its terms with a prefix, which are rows in a row of each file."""
        rows = self.at.raw("terms")
        rows = rows.filter(F.startswith("term", F.lit(prefix))) if prefix is not None else rows
        return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df > 0")

    def _known(self, terms: set[str]) -> list:
        """Dictionary rows of some terms by tier; a query has few."""
        rows = self.at.raw("terms").filter(F.col("term").isin(sorted(terms)))
        return rows.groupBy("term", "tier", "mean").agg(F.sum("df").alias("df"), F.max("most").alias("most")).collect()

    def matching(self, query: str) -> DataFrame:
        """(doc_id, page_number, score) of pages that match, from the postings of the query's terms.

        How many pages hold a word comes from the dictionary; phrases and
        prefixes are counted on their postings. Positions are read for phrases
        only, and the places of their words are intersected by hash.
        """
        node = parse(query)
        if node is None:
            raise ValueError("the query is empty")
        tf = C.tf_names(node)
        plain = {leaf: n for leaf, n in tf.items() if len(leaf.tokens) == 1 and not leaf.prefix}
        whole = {t for leaf in tf for t in (leaf.tokens[:-1] if leaf.prefix else leaf.tokens)}
        begins = {leaf.tokens[-1] for leaf in tf if leaf.prefix and leaf.tokens}
        rows = self.at.raw("postings").filter(reduce(lambda a, b: a | b, (F.startswith("term", F.lit(p)) for p in sorted(begins)), F.col("term").isin(sorted(whole))))
        fits = lambda leaf, at: F.startswith("term", F.lit(leaf.tokens[at])) if leaf.prefix and at == len(leaf.tokens) - 1 else F.col("term") == leaf.tokens[at]
        begun = lambda k: F.transform("positions", lambda x: x - k)
        columns = [F.max("dl").alias("dl")]
        for leaf, n in tf.items():
            if len(leaf.tokens) == 1:
                columns.append(F.coalesce(F.sum(F.when(fits(leaf, 0), F.col("tf"))), F.lit(0)).alias(n))
            else:
                columns += [F.flatten(F.collect_list(F.when(fits(leaf, k), begun(k)))).alias(f"{n}_{k}") for k in range(len(leaf.tokens))]
        found = self.at.alive(rows).groupBy("doc_id", "page_number").agg(*columns)
        phrase = lambda leaf, n: F.size(reduce(F.array_intersect, (F.col(f"{n}_{k}") for k in range(len(leaf.tokens))))) if leaf.tokens else F.lit(0)
        counted = found.select("doc_id", "page_number", "dl", *((F.col(n) if len(leaf.tokens) == 1 else phrase(leaf, n)).alias(n) for leaf, n in tf.items()))
        n_pages, mean = self.totals()
        df = Counter()
        for r in self._known({leaf.tokens[0] for leaf in plain}) if plain else []:
            df[r["term"]] += r["df"]
        known = {"_pages": n_pages, "_mean": mean} | {f"_df{n}": df[leaf.tokens[0]] for leaf, n in plain.items()}
        hits = counted.filter(C.predicate(node, tf)).select("*", *(F.lit(float(v)).alias(c) for c, v in known.items()))
        if others := [n for n in tf.values() if n not in plain.values()]:
            with_leaf = counted.agg(*(F.coalesce(F.sum((F.col(n) > 0).cast("long")), F.lit(0)).alias(f"_df{n}") for n in others))
            hits = hits.crossJoin(F.broadcast(with_leaf))  # one row
        return hits.select("doc_id", "page_number", (-C.score(node, tf)).alias("score"))

    def top(self, documents: DataFrame, query: str, f: Filter.Filters = Filter.Filters(), limit: int = 50, offset: int = 0, small: int = SMALL) -> Top | None:
        """The slice of documents by (score, doc_id) without scoring all matches; None where only the full way gives it.

        A round reads the postings of the best tiers, looks up whole scores of
        their documents in the page table, and ends the search when no document
        that was not met can score as well as the last one of the slice. Words
        only: phrases and prefixes have no bounds in the dictionary. Lists of
        ``small`` postings and less are read at once the full way, and so are those
        of which a round would look up more than ``LOOKED_UP``.
        """
        node, want = parse(query), limit + offset
        times = Counter(_positive(node))
        if want <= 0 or any(leaf.prefix or len(leaf.tokens) != 1 for leaf in times):
            return None
        n_pages, mean = self.totals()
        df, lists = Counter(), {leaf.tokens[0]: [] for leaf in times}
        for r in self._known(set(lists)):
            df[r["term"]] += r["df"]
            if r["tier"] >= 0:
                lists[r["term"]].append(r)
        idf = {t: max(math.log((n_pages - df[t] + 0.5) / (df[t] + 0.5)), C.LEAST_IDF) for t in lists}
        # what a posting of a tier adds at most, and how many there are
        bounds = {t: _by_tier(rows, lambda r, t=t: idf[t] * (C.K1 + 1) * _bound(r["most"], r["mean"], mean) * times[Leaf((t,))] * (1 + 1e-9)) for t, rows in lists.items()}
        total, read, need = sum(b[2] for own in bounds.values() for b in own), 0, max(200, ROUND * want)
        if total <= small:
            return None
        taken = dict.fromkeys(bounds, 0)
        left = lambda t: max((b[1] for b in bounds[t][taken[t] :]), default=0.0)
        while True:
            while read < need and any(taken[t] < len(bounds[t]) for t in bounds):
                t = max((t for t in bounds if taken[t] < len(bounds[t])), key=left)
                read += bounds[t][taken[t]][2]
                taken[t] += 1
            if read > LOOKED_UP:  # too many to look up: all are scored, from all postings
                found = search.rank(self.matching(query), documents, f).orderBy("score", "doc_id")
                return Top(found.offset(offset).limit(limit), total, total)
            tiers = [(F.col("term") == t) & (F.col("tier") >= bounds[t][k - 1][0]) for t, k in taken.items() if k]
            if not tiers:
                return Top(search.rank(self.matching(query), documents, f).limit(0), 0, total)
            met = self.at.alive(self.at.raw("postings").filter(reduce(lambda a, b: a | b, tiers)).select("doc_id", "_order")).distinct()
            ids = [r["doc_id"] for r in met.collect()]
            rows = search.rank(self._scores(node, ids, n_pages, mean), documents, f).orderBy("score", "doc_id").limit(want)
            best = rows.collect()
            if all(k == len(bounds[t]) for t, k in taken.items()) or (len(best) == want and sum(map(left, bounds)) < -best[-1]["score"]):
                slice_ = self.at.spark.createDataFrame(best[offset:], rows.schema).orderBy("score", "doc_id")
                return Top(slice_, read, total)
            need *= ROUND

    def _scores(self, node: Node, ids: list, n_pages: int, mean: float) -> DataFrame:
        """(doc_id, page_number, score) of the matching pages of some documents, from the page table."""
        tf, tokens = C.tf_names(node), F.col("tokens")
        df = Counter()
        for r in self._known({leaf.tokens[0] for leaf in _positive(node)}):
            df[r["term"]] += r["df"]
        known = {"_pages": n_pages, "_mean": mean} | {f"_df{n}": df[leaf.tokens[0]] if len(leaf.tokens) == 1 else 0 for leaf, n in tf.items()}
        chosen = self.pages().filter(F.col("doc_id").isin(ids)).filter(C.matches(node, tokens))
        return chosen.select("doc_id", "page_number", "dl", *(C.frequency(leaf, tokens).alias(n) for leaf, n in tf.items()), *(F.lit(float(v)).alias(c) for c, v in known.items())).select("doc_id", "page_number", (-C.score(node, tf)).alias("score"))
