"""Relations of the engine derived from the supplied tables.

A document's lines stand for pages, its language and source for codes of its
file name; see each function for the rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.functions import text as T
from leafmark.sources import walk

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _name(doc_id: Column, lang: Column, source: Column) -> Column:
    kind = F.element_at(F.array(*map(F.lit, ("DTL", "SPC", "REG"))), (doc_id % 3 + 1).cast("int"))
    number, revision = F.lpad((doc_id % 1000).cast("string"), 3, "0"), F.element_at(F.array(*map(F.lit, "ABC")), (doc_id % 3 + 1).cast("int"))
    good = F.concat_ws("-", F.lit("1800"), F.upper(lang), F.replace(source, F.lit("src"), F.lit("D")), kind, number, F.concat(revision, F.lit(".pdf")))
    return F.when(doc_id % 7 == 0, F.concat(F.lit("notes_"), doc_id.cast("string"), F.lit(".pdf"))).otherwise(good)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document registry: one row a document with path, content hash and size."""
    d = table(spark, sf_dir, "documents")
    name = _name(F.col("doc_id"), F.col("lang"), F.col("source"))
    return d.select("doc_id", F.concat_ws("/", "source", name).alias("file_path"), F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"), F.octet_length("text").cast("long").alias("file_size"))


def page_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, page_number, text): non-blank lines with their places, stripped."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page_number", "line"))
    return lines.select("doc_id", "page_number", T.strip(F.col("line")).alias("text")).filter("text != ''")


def index_pages(pages: DataFrame) -> DataFrame:
    """``pages`` with normalized_text, its tokens, and dl: the tokens of all four indexed columns."""
    p = pages.withColumn("normalized_text", T.normalize_text(F.col("text")))
    p = p.withColumn("tokens", T.tokens(F.col("normalized_text")))
    length = F.size(T.tokens(F.col("doc_id").cast("string"))) + 1 + F.size(T.tokens(F.col("text"))) + F.size("tokens")
    return p.withColumn("dl", length)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_pages(page_lines(table(spark, sf_dir, "documents")))


def _number(source: Column) -> Column:
    return F.substring(source, 4, 10).try_cast("int")


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(category, code): languages after d, even sources, and the kinds of the file names but REG; so unmatched documents exist."""
    d = table(spark, sf_dir, "documents")
    kinds = registry(spark, sf_dir).select(T.parsed_file_name(F.col("file_path"))["document_type_code"].alias("code")).filter("code != 'REG'")
    row = lambda category, rows: rows.distinct().select(F.lit(category).alias("category"), "code")
    languages = d.filter("lang >= 'e'").select(F.upper("lang").alias("code"))
    sources = d.filter(_number(F.col("source")) % 2 == 0).select(F.replace("source", F.lit("src"), F.lit("D")).alias("code"))
    return row("objects", languages).unionAll(row("disciplines", sources)).unionAll(row("documentTypes", kinds))


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(category, alias, code, lang, seq), as listed: aliases may repeat, stand for several codes and for codes that aren't known.

    Other languages stand for English and French, suppliers for a language,
    odd sources for the one before, market segments for a source, REG for SPC
    and types of parts for DTL.
    """
    d, of = table(spark, sf_dir, "documents"), lambda name: table(spark, sf_dir, name)
    languages = d.filter("lang < 'e'").select(F.upper("lang").alias("alias")).distinct()
    twice = languages.select("alias", F.explode(F.array(*(F.struct(F.lit(c).alias("code"), F.lit(x).alias("lang"), F.lit(i).alias("seq")) for i, (c, x) in enumerate((("EN", "en"), ("FR", "ru")))))).alias("r")).select("alias", "r.*")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    suppliers = of("supplier").select(F.lower("s_name").alias("alias"), pick(("EN", "FR", "ES", "DE"), F.col("s_nationkey")).alias("code"), pick(("en", "ru", None), F.col("s_suppkey")).alias("lang"), (F.col("s_suppkey") + 10).cast("int").alias("seq"))
    odd = d.select(_number(F.col("source")).alias("n")).filter("n % 2 = 1").distinct()
    odd = odd.select(F.concat(F.lit("D"), "n").alias("alias"), F.concat(F.lit("D"), F.col("n") - 1).alias("code"), F.when(F.col("n") % 4 == 1, "en").alias("lang"), F.col("n").alias("seq"))
    segments = of("customer").groupBy(F.lower("c_mktsegment").alias("alias")).agg(F.min("c_custkey").alias("first"))
    segments = segments.select("alias", F.concat(F.lit("D"), 2 * (F.col("first") % 12)).alias("code"), F.lit("ru").alias("lang"), (F.col("first") + 100).cast("int").alias("seq"))
    reg = registry(spark, sf_dir).select(T.parsed_file_name(F.col("file_path"))["document_type_code"].alias("alias")).filter("alias = 'REG'").distinct()
    reg = reg.select("alias", F.lit("SPC").alias("code"), F.lit("ru").alias("lang"), F.lit(0).alias("seq"))
    parts = of("part").groupBy(F.lower("p_type").alias("alias")).agg(F.min("p_partkey").alias("first"))
    parts = parts.select("alias", F.lit("DTL").alias("code"), F.lit("en").alias("lang"), (F.col("first") + 100).cast("int").alias("seq"))
    rows = [("objects", twice), ("objects", suppliers), ("disciplines", odd), ("disciplines", segments), ("documentTypes", reg), ("documentTypes", parts)]
    return reduce(lambda a, b: a.unionAll(b), (r.select(F.lit(category).alias("category"), "alias", "code", "lang", "seq") for category, r in rows))


def previous_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier scan knew: of ten documents six as they are, one with another hash, one with another time, one at another path, one missing and one of each hundred of those."""
    r = registry(spark, sf_dir).withColumn("last_modified", F.lit("2024-01-01T00:00:00+00:00"))
    turn = F.col("doc_id") % 10
    return r.filter(turn != 9).select(
        "doc_id",
        F.when(turn == 8, F.concat(F.lit("moved/"), "file_path")).otherwise(F.col("file_path")).alias("file_path"),
        F.when(turn == 6, F.lit("changed")).otherwise(F.col("file_hash")).alias("file_hash"),
        F.when(turn == 6, F.col("file_size") + 1).otherwise(F.col("file_size")).alias("cached_size"),
        F.when(turn == 7, F.lit("2023-01-01T00:00:00+00:00")).otherwise(F.col("last_modified")).alias("cached_mtime"),
    )


def found_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a walk of the folders finds now."""
    return registry(spark, sf_dir).select("file_path", "file_size", F.lit("2024-01-01T00:00:00+00:00").alias("last_modified"), "file_hash")


def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word i of a line at x 10 * i, lines 12 apart; a line is a page, and every fifth page is turned by 90 degrees."""
    p = page_lines(table(spark, sf_dir, "documents"))
    w = p.select("doc_id", "page_number", F.posexplode(F.split("text", " +")).alias("word_no", "original")).filter("original != ''")
    x0, y0 = F.col("word_no") * 10.0, F.lit(12.0)
    turned = F.col("page_number") % 5 == 4
    box = {"x0": (x0, y0), "y0": (y0, x0), "x1": (x0 + 8, y0 + 10), "y1": (y0 + 10, x0 + 8)}
    placed = [F.when(turned, b).otherwise(a).cast("double").alias(c) for c, (a, b) in box.items()]
    return w.select("doc_id", "page_number", *placed, "original", T.normalize_text(F.col("original")).alias("normalized"), F.lit(0).alias("block_no"), F.lit(0).alias("line_no"), "word_no", F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"))


def _pick(names: tuple[str, ...], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (key % len(names) + 1).cast("int"))


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(module_name, version, api_version): a module for each supplier."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    return table(spark, sf_dir, "supplier").select(F.col("s_name").alias("module_name"), F.concat_ws(".", k % 3, k % 5).alias("version"), F.concat(F.lit("1."), n % 4).alias("api_version"))


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(module_name, needs, constraint): a supplier needs the one with half its number, those of nation 3 one that isn't there too."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    half = F.concat(F.lit("Supplier#"), F.lpad(F.floor(k / 2).cast("string"), 9, "0"))
    first = s.filter("s_suppkey >= 1").select(F.col("s_name").alias("module_name"), half.alias("needs"), _pick((">=1.1,<2", "", "!=1.2", "<=1.2"), k).alias("constraint"))
    return first.unionAll(s.filter("s_nationkey = 3").select("s_name", F.lit("nation_3"), F.lit(">=1")))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modules with what their manifests say; a name has two manifests, and some manage a table."""
    k = F.col("s_suppkey")
    libraries = F.when(k % 3 == 0, F.array(F.lit("numpy"))).when(k % 3 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("numpy"), F.lit("nowhere")))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("module_name"), _pick(("", ">=1.2,<2", ">=1", "<=1.4", ">=2"), k).alias("core_constraint"), libraries.alias("libraries"), F.when(k % 7 == 0, F.array(F.lit("notes"))).otherwise(F.array().cast("array<string>")).alias("managed_tables"))
    fixed = {"entry_point": F.lit("x:X"), "scan_phase": F.lit("secondary"), "description": F.lit(""), "data_version": F.lit(1), "folder": F.explode(F.array(F.lit("a/"), F.lit("b/")))}
    whole = modules(spark, sf_dir).join(rows, "module_name").withColumns(fixed)
    return whole.withColumn("version", F.when(F.col("folder") == "a/", F.col("version")).otherwise("9")).withColumn("path", F.concat("folder", "module_name")).drop("folder")


def document_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Write each text as a file source/lang/doc_id.txt below a folder; a null one is empty. A task that runs again replaces its files."""

    def write(frames):
        for frame in frames:
            for key, lang, source, text in frame.itertuples(index=False):
                with walk.created(f"{folder}/{source}/{lang}/{key}.txt") as f:
                    f.write((text or "").encode())
            yield frame[["doc_id"]]

    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source"), "text")
    rows.mapInPandas(write, "doc_id long").write.format("noop").mode("overwrite").save()
