"""From file names to codes: parsing, dimensions with aliases, unmatched documents, suggestions."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions import text as T

#: Category of each code column.
CATEGORIES = {"object_code": "objects", "discipline_code": "disciplines", "document_type_code": "documentTypes"}


def first_aliases(aliases: DataFrame, codes: DataFrame) -> DataFrame:
    """One row for each category and alias: the first listed; aliases of unknown codes go."""
    known = aliases.join(codes, ["category", "code"], "left_semi")
    first = F.row_number().over(Window.partitionBy("category", "alias").orderBy("seq"))
    return known.withColumn("_n", first).filter("_n = 1").drop("_n")


def resolve(documents: DataFrame, codes: DataFrame, aliases: DataFrame, parser: Callable[[Column], dict[str, Column]] = T.parsed_file_name) -> DataFrame:
    """``documents`` with the three codes and unmatched_flag from their file_path.

    A parsed value that is a code stays; else an alias gives its code. The flag
    is 0 if all three are found. Names that don't parse have null codes. The
    dimensions are joined by hash; Spark broadcasts them while they are small.
    """
    d = documents.drop(*CATEGORIES, "unmatched_flag").withColumns({f"_{k}": v for k, v in parser(F.col("file_path")).items()})
    alias = first_aliases(aliases, codes)
    for column, category in CATEGORIES.items():
        own = codes.filter(F.col("category") == category).select(F.col("code").alias(f"_{column}"), F.col("code").alias("_own"))
        other = alias.filter(F.col("category") == category).select(F.col("alias").alias(f"_{column}"), F.col("code").alias("_other"))
        d = d.join(own.distinct(), f"_{column}", "left").join(other, f"_{column}", "left")
        d = d.withColumn(column, F.coalesce("_own", "_other")).drop("_own", "_other")
    found = F.col("_is_valid")
    for column in CATEGORIES:
        found = found & F.col(column).isNotNull()
    d = d.withColumn("unmatched_flag", F.when(found, 0).otherwise(1))
    return d.drop("_is_valid", *(f"_{c}" for c in CATEGORIES))


def unmatched_summary(documents: DataFrame) -> DataFrame:
    return documents.groupBy("unmatched_flag").agg(F.count("*").alias("n"), F.count("object_code").alias("with_object"), F.count("discipline_code").alias("with_discipline"), F.count("document_type_code").alias("with_type"))


def by_language(aliases: DataFrame, lang: str | None) -> DataFrame:
    """Aliases for ``en``, for ``ru`` (those without language too), all for None, none for others."""
    if lang is None:
        return aliases
    wanted = F.col("lang") == lang if lang == "en" else (F.col("lang") == "ru") | F.col("lang").isNull() if lang == "ru" else F.lit(False)
    return aliases.filter(wanted)


def alias_conflicts(aliases: DataFrame) -> DataFrame:
    """(category, alias, n_codes) of aliases that stand for several codes."""
    return aliases.groupBy("category", "alias").agg(F.countDistinct("code").alias("n_codes")).filter("n_codes > 1")


def sheet_references(rows: DataFrame, category: str) -> tuple[DataFrame, DataFrame]:
    """Codes and aliases of a sheet with columns code, en and ru; ValueError if an alias has two codes in a language."""
    r = rows.select(*(T.strip(F.col(c).cast("string")).alias(c) for c in ("code", "en", "ru"))).filter("code != ''")
    pairs = r.select("code", F.explode(F.array(*(F.struct(F.lit(c).alias("lang"), F.col(c).alias("alias")) for c in ("en", "ru")))).alias("a")).select("code", "a.lang", "a.alias").filter("alias != ''").distinct()
    twice = pairs.groupBy("lang", "alias").agg(F.count("*").alias("n")).filter("n > 1").orderBy("lang", "alias").head()
    if twice:
        raise ValueError(f"the alias {twice['alias']!r} stands for several codes")
    codes = r.select(F.lit(category).alias("category"), "code").distinct()
    return codes, pairs.select(F.lit(category).alias("category"), "alias", "code", "lang", F.when(F.col("lang") == "en", 0).otherwise(1).alias("seq"))


def export(payloads: DataFrame, path: str) -> None:
    """Write the payload as one JSON file: first beside the target, then renamed onto it."""
    spark = payloads.sparkSession
    raw = lambda c: F.from_json(c, "array<struct<alias: string, code: string>>").alias(c)
    part = payloads.select("category", F.struct(F.from_json("codes", "array<string>").alias("codes"), raw("aliases_en"), raw("aliases_ru")).alias("p"))
    whole = part.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "p"))))).alias("value"))
    beside = f"{path}.parts-{uuid.uuid4().hex}"
    whole.coalesce(1).write.text(beside)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    made = [s.getPath() for s in system.listStatus(hadoop.Path(beside)) if s.getPath().getName().startswith("part-")]
    # one step that replaces the target, so a reader finds the old file or the new one
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(made[0]), context.makeQualified(target), options)
    system.delete(hadoop.Path(beside), True)


def emptiness(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of reference tables."""
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``table`` with the rows whose keys it does not have, one for each key; only an empty table is filled."""
    if not table.isEmpty():
        return table
    order = [c for c in rows.columns if c not in key]
    one = rows.groupBy(*key).agg(F.min(F.struct(*order)).alias("_r")).select(*key, "_r.*") if order else rows.distinct()
    return table.unionByName(one.select(*table.columns))


def attempted(rows: DataFrame) -> int:
    """How many rows an insert is tried with, those that are ignored included."""
    return rows.count()


def payload(codes: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row a category: sorted codes and aliases in English and Russian, as JSON."""
    alias = first_aliases(aliases, codes)
    pair = F.struct("alias", "code")
    listed = lambda cond: F.sort_array(F.collect_list(F.when(cond, pair)))
    of = alias.groupBy("category").agg(listed(F.col("lang") == "en").alias("en"), listed((F.col("lang") == "ru") | F.col("lang").isNull()).alias("ru"))
    c = codes.groupBy("category").agg(F.sort_array(F.collect_set("code")).alias("codes"))
    json = lambda x: F.coalesce(F.to_json(x), F.lit("[]"))
    return c.join(of, "category", "left").select("category", json(F.col("codes")).alias("codes"), json(F.col("en")).alias("aliases_en"), json(F.col("ru")).alias("aliases_ru"))


def suggest(codes: DataFrame, aliases: DataFrame, category: str, typed: str) -> DataFrame:
    """(left, right, code, code_on_left) for what a user types.

    Codes that begin with it, with their first Russian alias; without such
    codes, aliases that begin with it: Russian ones for Cyrillic input, else
    English ones. Blank input gives nothing.
    """
    typed = typed.strip().lower()
    codes, aliases = codes.filter(F.col("category") == category), first_aliases(aliases, codes).filter(F.col("category") == category)
    begins = lambda c: F.startswith(F.lower(c), F.lit(typed)) & F.lit(bool(typed))
    code_like = bool(typed) and all(c in "0123456789abcdefghijklmnopqrstuvwxyz-." for c in typed)
    russian = any("а" <= c <= "я" or c == "ё" for c in typed)
    ru = by_language(aliases, "ru").groupBy("code").agg(F.min_by("alias", "seq").alias("right"))
    hits = codes.filter(begins(F.col("code")) & F.lit(code_like)).select("code").distinct()
    by_code = hits.join(ru, "code", "left").select(F.col("code").alias("left"), F.coalesce("right", F.lit("")).alias("right"), "code", F.lit(True).alias("code_on_left"))
    chosen = by_language(aliases, "ru" if russian else "en")
    none = hits.agg(F.count("*").alias("_hits")).filter("_hits = 0")
    by_alias = chosen.filter(begins(F.col("alias"))).join(F.broadcast(none)).select(F.col("alias").alias("left"), F.col("code").alias("right"), "code", F.lit(False).alias("code_on_left"))
    return by_code.unionAll(by_alias)
