"""Files as sources: folder scans, page extraction, reference and manifest JSON."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.functions import text as T
from leafmark.sources import walk


def any_case(extension: str) -> str:
    """A glob for an extension in any case."""
    return "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)


def scan(spark: SparkSession, folder: str, extension: str = "pdf", content: bool = True, algorithm: str = "sha256") -> DataFrame:
    """(file_path, relative_path, file_name, file_size, last_modified, content, file_hash) of files below a folder.

    Folders are walked by jobs (``walk``). Without ``content`` files are not read,
    so a join on path, size and time can decide first which to hash (``walk.hashed``
    does it without holding them). Empty files have no hash, unreadable ones neither
    hash nor content; a folder that doesn't exist gives no rows.
    """
    found = walk.walk(spark, folder).filter("error IS NULL").filter(F.endswith(F.lower("path"), F.lit("." + extension.lower())))
    base = folder if (plain := walk.local(folder)) is None else "file:" + plain
    relative = F.regexp_replace("path", r"^\Q" + base.rstrip("/") + r"\E/", "")
    out = found.select(
        F.col("path").alias("file_path"), relative.alias("relative_path"), T.file_name(F.col("path")).alias("file_name"), F.col("length").alias("file_size"),
        F.date_format(F.to_utc_timestamp(F.timestamp_micros("modified_us"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("last_modified"),
    )
    return walk.contents(out, algorithm) if content else out


def listing(files: DataFrame, limit: int = 500, offset: int = 0) -> DataFrame:
    """A slice of files in path order."""
    return files.orderBy("file_path").offset(offset).limit(limit)


#: Bytes of a file to its pages' texts; an error or None where the file can't be opened.
Extractor = Callable[[bytes], list[str] | None]


def text_extractor(data: bytes) -> list[str]:
    """Pages of a plain text, parted by form feeds."""
    return data.decode("utf-8", "replace").split("\f")


def extract_pages(files: DataFrame, extract: Extractor = text_extractor) -> DataFrame:
    """(doc_id, page_count, page_number, text) of files (doc_id, content); a file that can't be read gives one row without page and text."""
    kind = files.schema["doc_id"].dataType.simpleString()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, data in zip(frame["doc_id"], frame["content"]):
                try:
                    found = extract(bytes(data))
                except Exception:  # any broken file
                    found = None
                if found is None:
                    yield pd.DataFrame({"doc_id": [key], "page_count": [None], "page_number": [None], "text": [None]})
                elif found:
                    yield pd.DataFrame({"doc_id": key, "page_count": len(found), "page_number": range(len(found)), "text": [t.strip() for t in found]})

    return files.select("doc_id", "content").mapInPandas(read, f"doc_id {kind}, page_count int, page_number int, text string")


def ingest_new(spark: SparkSession, folder: str, path: str, checkpoint: str, extension: str = "pdf", extract: Extractor = text_extractor, files: int = 1000):
    """Start extracting what came into a folder since the last run with this ``checkpoint``; pages go to Parquet at ``path``.

    ``files`` are taken at a time, so a run that is stopped goes on where it was;
    the id of a document is the hash of its content. Returns the streaming query.
    """
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True)
    new = raw.option("pathGlobFilter", any_case(extension)).option("maxFilesPerTrigger", files).load(folder)
    pages = extract_pages(new.select(F.sha2("content", 256).alias("doc_id"), "content"), extract)
    return pages.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Sheets of a reference workbook and their categories.
SHEETS = {"wbs": "objects", "type": "documentTypes", "discipline": "disciplines"}
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def workbook(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Category to rows (code, en, ru): the first three columns of the sheets of an .xlsx file; ValueError if one of ``SHEETS`` is missing.

    A workbook is small; the driver reads it.
    """
    data = spark.read.format("binaryFile").load(path).select("content").head()
    with zipfile.ZipFile(io.BytesIO(bytes(data["content"]))) as book:
        tree = lambda name: ElementTree.fromstring(book.read(name))
        said = lambda x: "".join(t.text or "" for t in x.iter(f"{_SHEET}t"))
        shared = [said(x) for x in tree("xl/sharedStrings.xml").iter(f"{_SHEET}si")] if "xl/sharedStrings.xml" in book.namelist() else []
        targets = {r.get("Id"): r.get("Target").removeprefix("/xl/") for r in tree("xl/_rels/workbook.xml.rels")}
        parts = {x.get("name"): "xl/" + targets[x.get(_LINK)] for x in tree("xl/workbook.xml").iter(f"{_SHEET}sheet")}
        if missing := [name for name in SHEETS if name not in parts]:
            raise ValueError(f"no sheet {', '.join(missing)}")

        def cell(x: ElementTree.Element) -> str | None:
            if x.get("t") == "inlineStr":
                return said(x)
            value = x.findtext(f"{_SHEET}v")
            return shared[int(value)] if value is not None and x.get("t") == "s" else value

        def rows(name: str) -> list[tuple]:
            out = []
            for row in tree(parts[name]).iter(f"{_SHEET}row"):
                by = {re.sub(r"\d", "", x.get("r", "")): cell(x) for x in row}
                out.append(tuple(by.get(c) for c in "ABC"))
            return out

        return {category: spark.createDataFrame(rows(name), "code string, en string, ru string") for name, category in SHEETS.items()}


REFERENCE = "codes array<string>, aliases_en array<struct<alias: string, code: string>>, aliases_ru array<struct<alias: string, code: string>>"
CATEGORIES = ("objects", "disciplines", "documentTypes")


def references(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Codes (category, code) and aliases (category, alias, code, lang, seq) of a reference file.

    A file that lacks a category or one of its lists gives nothing. Blank codes
    and aliases go; of aliases that repeat the first stays, English before
    Russian; aliases of codes that aren't listed go.
    """
    raw = spark.read.schema(", ".join(f"{c} struct<{REFERENCE.replace(' array', ': array')}>" for c in CATEGORIES)).option("multiLine", True).json(path)
    whole = raw.filter(" AND ".join(f"{c}.{part} IS NOT NULL" for c in CATEGORIES for part in ("codes", "aliases_en", "aliases_ru")))
    by = whole.select(F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("r")) for c in CATEGORIES))).alias("x")).select("x.category", "x.r.*")
    codes = by.select("category", F.explode(F.transform("codes", T.strip)).alias("code")).filter("code != ''").distinct()

    def named(lang: str) -> Column:
        return F.transform(f"aliases_{lang}", lambda a: F.struct(T.strip(a["alias"]).alias("alias"), T.strip(a["code"]).alias("code"), F.lit(lang).alias("lang")))

    listed = by.select("category", F.posexplode(F.concat(named("en"), named("ru"))).alias("seq", "a"))
    pairs = listed.select("category", "a.alias", "a.code", "a.lang", "seq").filter("alias != '' AND code != ''")
    return codes, pairs.join(codes, ["category", "code"], "left_semi").groupBy("category", "alias").agg(F.min(F.struct("seq", "code", "lang")).alias("f")).select("category", "alias", "f.code", "f.lang", "f.seq")


MANIFEST = "module_name string, version string, api_version string, entry_point string, scan_phase string, description string, managed_tables array<string>, data_version int"


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Manifests of the modules below a folder, with their paths; broken ones have nulls."""
    return spark.read.schema(MANIFEST).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").json(folder).withColumn("path", F.input_file_name())
