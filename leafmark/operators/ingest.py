"""Ingest: change detection, content dedup, page plans, index state, upserts and deletes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions import text as T
from leafmark.sources.versions import GONE, Versions

SKIPPED, DUPLICATE, TO_INDEX, ERROR = "skipped", "duplicate", "to_index", "error"


def detect_changes(files: DataFrame, index: DataFrame) -> DataFrame:
    """``files`` (file_path, file_size, last_modified, file_hash) with known_id, outcome and duplicate_of.

    Same path, size and time: skipped, whatever the hash. Else an empty file or
    one without hash is an error; a hash that the index has, or that an earlier
    path of the same scan has, is a duplicate; the rest are to be indexed, under
    their known id if the path is known.
    """
    by_path = index.select("file_path", F.col("doc_id").alias("known_id"), "cached_size", "cached_mtime")
    by_hash = index.groupBy("file_hash").agg(F.min("doc_id").alias("hash_id"))
    f = files.join(by_path, "file_path", "left").join(by_hash, "file_hash", "left")
    same = (F.col("cached_size") == F.col("file_size")) & (F.col("cached_mtime") == F.col("last_modified"))
    bad = (F.col("file_size") == 0) | F.col("file_hash").isNull()
    f = f.withColumn("_state", F.when(same, SKIPPED).when(bad, ERROR).when(F.col("hash_id").isNotNull(), DUPLICATE).otherwise(TO_INDEX))
    # the first path of a hash is indexed, the others of this scan are its duplicates; skipped files hold no hash of their own
    fresh = f.filter(F.col("_state") == TO_INDEX).groupBy("file_hash").agg(F.min("file_path").alias("_first"))
    f = f.join(fresh, "file_hash", "left")
    twin = (F.col("_state") == TO_INDEX) & (F.col("_first") != F.col("file_path"))
    outcome = F.when(twin, DUPLICATE).otherwise(F.col("_state"))
    return f.select(*files.columns, "known_id", outcome.alias("outcome"), F.when(twin, F.col("_first")).when(F.col("_state") == DUPLICATE, F.col("hash_id").cast("string")).alias("duplicate_of"))


def scan_counters(changes: DataFrame) -> DataFrame:
    """One row: files by outcome, those processed and their percentage."""
    n = lambda state: F.sum((F.col("outcome") == state).cast("long"))
    c = changes.agg(F.count("*").alias("total"), *(F.coalesce(n(s), F.lit(0)).alias(s) for s in (TO_INDEX, DUPLICATE, SKIPPED, ERROR)))
    done = F.col(TO_INDEX) + F.col(DUPLICATE) + F.col(SKIPPED) + F.col(ERROR)
    return c.select("*", done.alias("processed"), T.percent(done, F.col("total")).alias("percent"))


def first_of_hash(documents: DataFrame) -> DataFrame:
    """The document with the first path of each content hash."""
    first = F.min_by(F.struct(*documents.columns), F.struct("file_path", "doc_id"))
    return documents.groupBy("file_hash").agg(first.alias("_first")).select("_first.*")


def index_status(files: DataFrame, index: DataFrame) -> DataFrame:
    """``files`` with status new, duplicate, indexed or modified.

    Known path: indexed if size and time or the hash agree, else modified (so is
    a file that can't be hashed). Unknown path: duplicate if the index has the
    hash, else new.
    """
    by_path = index.select("file_path", F.col("file_hash").alias("_hash"), "cached_size", "cached_mtime", F.lit(True).alias("_known"))
    hashes = index.select(F.col("file_hash"), F.lit(True).alias("_seen")).filter("file_hash IS NOT NULL").distinct()
    f = files.join(by_path, "file_path", "left").join(hashes, "file_hash", "left")
    same = ((F.col("cached_size") == F.col("file_size")) & (F.col("cached_mtime") == F.col("last_modified"))) | (F.col("_hash") == F.col("file_hash"))
    status = F.when(F.col("_known") & same, "indexed").when(F.col("_known"), "modified").when(F.col("_seen"), "duplicate").otherwise("new")
    return f.select(*files.columns, status.alias("status"))


def index_state(status: DataFrame) -> DataFrame:
    """One row: counts, percentage and the state of the whole index."""
    n = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0))
    c = status.agg(F.count("*").alias("total"), n("indexed").alias("indexed"), n("duplicate").alias("duplicates"), (n("new") + n("modified")).alias("unindexed"))
    state = (
        F.when(F.col("total") == 0, "no_source_files").when((F.col("indexed") == 0) & (F.col("duplicates") == 0), "empty")
        .when((F.col("unindexed") == 0) & (F.col("indexed") > 0), "fully_indexed").when(F.col("unindexed") == 0, "needs_update")
        .when(F.col("indexed") > 0, "partially_indexed").otherwise("needs_update")
    )
    return c.select("*", T.percent(F.col("indexed") + F.col("duplicates"), F.col("total")).alias("percent"), state.alias("state"))


def page_plan(docs: DataFrame, keep_empty: bool = False) -> DataFrame:
    """(doc_id, page_count, pages): pages as structs of number, text and normalised text; page_count counts empty ones too."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("page_number"), T.strip(x).alias("text"), T.normalize_text(T.strip(x)).alias("normalized_text")))
    kept = lines if keep_empty else F.filter(lines, lambda p: p["text"] != "")
    return docs.select("doc_id", F.size(F.split("text", "\n")).alias("page_count"), kept.alias("pages"))


def upsert(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``new`` and those of ``old`` with other keys; of rows that repeat a key in ``new``, the last by all columns stays."""
    last = new.groupBy(key).agg(F.max(F.struct(*new.columns)).alias("_last")).select("_last.*")
    return old.join(new.select(key), key, "left_anti").unionByName(last)


def split_plans(plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that can be written whole and those that can't: without id, with an id that an earlier plan has, or with a page without number or with a number twice."""
    numbers = F.transform("pages", lambda p: p["page_number"])
    bad_page = F.exists(numbers, lambda n: n.isNull()) | (F.size(F.array_distinct(numbers)) < F.size("pages"))
    order = Window.partitionBy("doc_id", "_ok").orderBy(F.size("pages"), F.xxhash64("pages"))
    ok = F.col("doc_id").isNotNull() & F.coalesce(~bad_page, F.lit(False))
    # of plans for one document the first that can be written is
    marked = plans.withColumn("_ok", ok).withColumn("_n", F.when(F.col("_ok"), F.row_number().over(order)))
    good = F.coalesce(F.col("_ok") & (F.col("_n") == 1), F.lit(False))
    return marked.filter(good).drop("_ok", "_n"), marked.filter(~good).drop("_ok", "_n")


def write_counts(plans: DataFrame) -> DataFrame:
    """One row (success, failed) of a batched write of plans."""
    good, bad = split_plans(plans)
    n = lambda x, ok: x.agg(F.count("*").alias("n")).select("n", F.lit(ok).alias("ok"))
    both = n(good, True).unionAll(n(bad, False))
    return both.agg(F.max(F.when(F.col("ok"), F.col("n"))).alias("success"), F.max(F.when(~F.col("ok"), F.col("n"))).alias("failed"))


def write_all(plans: DataFrame, tables: dict[str, DataFrame], path: str) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """Write plans that can be written into ``tables`` (documents: doc_id, page_count; pages: doc_id, page_number, text, normalized_text).

    Each document replaces its row and all its pages; what can't be written
    leaves no trace. Returns the tables, written below ``path``, and the counts.
    """
    good, _ = split_plans(plans)
    pages = good.select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.*")
    new = {"documents": upsert(tables["documents"], good.select("doc_id", "page_count")), "pages": delete(tables["pages"], good.select("doc_id")).unionByName(pages)}
    counts = write_counts(plans).head()
    for name, rows in new.items():
        rows.write.mode("errorifexists").parquet(f"{path}/{name}")
    read = plans.sparkSession.read.parquet
    return {name: read(f"{path}/{name}") for name in new}, counts.asDict()


def commit_plans(at: Versions, plans: DataFrame) -> tuple[Versions, dict[str, int]]:
    """The next version of documents (doc_id, page_count) and pages with the plans that can be written, in one step, and the counts.

    Each document replaces its row and all its pages. A run that breaks off
    leaves the version that was; what can't be written leaves no trace.
    """
    good, _ = split_plans(plans)
    pages = good.select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.*")
    counts = write_counts(plans).head().asDict()
    return at.add({"documents": good.select("doc_id", "page_count"), "pages": pages}, gone=good.select("doc_id")), counts


#: Columns of the documents that ``refresh`` keeps, besides doc_id.
FILES = "file_path string, file_hash string, cached_size long, cached_mtime string, page_count int"


def refresh(at: Versions, files: DataFrame, pages_of: Callable[[DataFrame], DataFrame], new_id: Column | None = None) -> Versions:
    """The next version after a scan: files (see ``detect_changes``) that are new or changed are indexed, the others stay as they are.

    ``pages_of`` gets (doc_id, file_path) of those to index and gives (doc_id,
    page_number, text); nothing else is read or extracted. A changed file keeps
    its id, a new one gets ``new_id`` of its path. Documents, their pages and
    the table ``outcomes`` (file_path, outcome, duplicate_of, run) appear in one
    step, so a scan that breaks off is simply done again.
    """
    new_id = T.stable_id(F.col("file_path")) if new_id is None else new_id
    known = at.table("documents")
    if known is None:
        kind = files.select(new_id.alias("doc_id")).schema["doc_id"].dataType.simpleString()
        known = at.spark.createDataFrame([], f"doc_id {kind}, {FILES}")
    # the decisions are written first, so that ids, pages and outcomes follow from the same ones
    order = max((p.order for p in at.parts), default=0) + 1
    found = detect_changes(files, known).withColumn("doc_id", F.coalesce("known_id", new_id))
    decided = at.write({"decided": found}, order=order)
    found = at.read(decided, "decided")
    fresh = found.filter(F.col("outcome") == TO_INDEX)
    pages = at.write({"pages": pages_of(fresh.select("doc_id", "file_path").distinct())}, order=order)
    count = at.read(pages, "pages").groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count"))
    rows = fresh.join(count, "doc_id", "left").select("doc_id", "file_path", "file_hash", F.col("file_size").alias("cached_size"), F.col("last_modified").alias("cached_mtime"), F.coalesce("page_count", F.lit(0)).alias("page_count"))
    rest = {"documents": rows, "outcomes": found.select("doc_id", "file_path", "outcome", "duplicate_of", F.lit(at.version + 1).alias("run"))}
    if at.parts:
        rest[GONE] = fresh.select("doc_id").distinct()
    return at.commit((*at.parts, pages, at.write(rest, order=order)))


def delete(table: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """``table`` without some documents; ids that it doesn't have don't matter."""
    return table.join(doc_ids.select("doc_id"), "doc_id", "left_anti")


def delete_cascade(tables: dict[str, DataFrame], doc_ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of some documents."""
    return {name: delete(table, doc_ids) for name, table in tables.items()}


def in_range(docs: DataFrame, page_number: int) -> DataFrame:
    """(doc_id, page_count, in_range): whether documents (doc_id, text) have a page of that number, counted from 0."""
    count = F.size(F.split("text", "\n"))
    return docs.select("doc_id", count.alias("page_count"), ((F.lit(page_number) >= 0) & (F.lit(page_number) < count)).alias("in_range"))


def max_version(versions: DataFrame) -> DataFrame:
    """One row with the largest applied schema version; 0 for a new index."""
    return versions.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))


def exists(table: DataFrame, column: str, value: object) -> bool:
    """Whether a row has a value; the scan ends with the first."""
    return not table.filter(F.col(column) == value).limit(1).isEmpty()


def lookup(documents: DataFrame, column: str, value: object) -> DataFrame:
    """The document with an id, hash or path."""
    if column not in ("doc_id", "file_hash", "file_path"):
        raise ValueError(f"no lookup by {column!r}")
    return documents.filter(F.col(column) == value)


def page_text(pages: DataFrame, doc_id: object, page_number: int) -> DataFrame:
    """One row with the text of a page; empty if there is none."""
    hit = pages.filter((F.col("doc_id") == doc_id) & (F.col("page_number") == page_number))
    return hit.agg(F.coalesce(F.first("text"), F.lit("")).alias("text"))


def page_texts(pages: DataFrame, documents: DataFrame, doc_ids: list, page_number: int) -> DataFrame:
    """(doc_id, text, status) for 1 to 20 ids: ``ok``, ``no_page`` or ``no_document``."""
    if not 1 <= len(doc_ids) <= 20:
        raise ValueError("ask for 1 to 20 documents")
    kind = documents.schema["doc_id"].dataType.simpleString()
    ids = documents.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(doc_ids)], f"doc_id {kind}")
    known = documents.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", F.lit(True).alias("_known"))
    texts = pages.filter(F.col("page_number") == page_number).join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "text")
    out = ids.join(known, "doc_id", "left").join(texts, "doc_id", "left")
    status = F.when(F.col("_known").isNull(), "no_document").when(F.col("text").isNull(), "no_page").otherwise("ok")
    return out.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), status.alias("status"))


def migrate(table: DataFrame, migrations: tuple, version: int) -> DataFrame:
    """``table`` of an older schema version with the columns that later versions added."""
    for at, column, kind, default in migrations:
        if at > version and column not in table.columns:
            table = table.withColumn(column, F.lit(default).cast(kind))
    return table


def latest_scan(scans: DataFrame) -> DataFrame:
    """The row with the largest scan_id."""
    columns: list[Column] = [F.max_by(c, "scan_id").alias(c) for c in scans.columns]
    return scans.agg(*columns).filter("scan_id IS NOT NULL")


def interrupt_stale(scans: DataFrame) -> DataFrame:
    """Scans that still claim to run, marked as interrupted."""
    return scans.withColumn("status", F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status")))
