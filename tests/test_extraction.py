"""Folders walked by jobs, guarded extraction, the page source in batches and as a stream."""

import hashlib
import os
import time

import pandas as pd
import pyarrow as pa
import pytest

from leafmark.operators import highlights
from leafmark.sources import extraction, files, walk


def extractor():
    """An extractor that goes to workers by value, since they don't have this module."""

    def pages(data):
        """One page a line; some texts hang, die or break."""
        import os
        import time

        from leafmark.sources.extraction import Page

        text = data.decode()
        if "hang" in text:
            time.sleep(600)
        if "die" in text:
            os._exit(3)
        if "none" in text:
            return None
        return [Page(line, 100.0, 50.0, [(10.0 * i, 5.0, 10.0 * i + 8, 15.0, w, 0, 0, i) for i, w in enumerate(line.split())]) for line in text.split("\n")] if text else []

    return pages


@pytest.fixture
def tree(tmp_path):
    top = tmp_path / "in"
    (top / "a" / "b" / "c").mkdir(parents=True)
    (top / "empty").mkdir()
    (top / "one.txt").write_text("der the\nthe")
    (top / "a" / "none.TXT").write_bytes(b"")
    (top / "a" / "b" / "c" / "deep é%20.txt").write_text("deep")
    (top / "a" / "other.bin").write_text("x")
    (top / "a" / "link.txt").symlink_to(top / "one.txt")
    (top / "a" / "round").symlink_to(top)
    (top / "a" / "lost.txt").symlink_to(top / "nowhere")
    return top


def test_a_walk_without_the_driver(spark, tree):
    found = {r.relative_path: r for r in files.scan(spark, str(tree), "txt").collect()}
    assert set(found) == {"one.txt", "a/none.TXT", "a/b/c/deep é%20.txt", "a/link.txt"}
    assert found["one.txt"].file_hash == hashlib.sha256(b"der the\nthe").hexdigest() and bytes(found["one.txt"].content) == b"der the\nthe"
    assert found["a/none.TXT"].file_size == 0 and found["a/none.TXT"].file_hash is None
    listed = files.scan(spark, str(tree), "txt", content=False)
    hashes = {r.relative_path: r.file_hash for r in walk.hashed(listed, "md5").collect()}
    assert hashes["a/link.txt"] == hashlib.md5(b"der the\nthe").hexdigest() and hashes["a/none.TXT"] is None
    with pytest.raises(ValueError):
        walk.hashed(listed, "no such algorithm")


def test_unreadable_folders_are_rows(spark, tree):
    gone = walk.walk(spark, str(tree / "nowhere")).collect()
    assert len(gone) == 1 and gone[0].path.endswith("nowhere") and gone[0].error
    names = list(walk._listed(iter([pd.DataFrame({"path": [str(tree / "gone"), str(tree / "empty"), str(tree / "a" / "b")]})])))
    rows = [tuple(r)[:2] for f in names for r in f.itertuples(index=False)]
    assert rows == [(str(tree / "gone"), False), (f"file:{tree}/a/b/c", True)]  # the others go on
    assert files.scan(spark, str(tree / "nowhere")).isEmpty()


def test_other_file_systems_list_alike(tree):
    plain = {os.path.basename(r[0]) for r in walk._entries(f"file:{tree}/a/b")}
    assert plain == {"c"} and walk.local("file:///x/y") == "/x/y" and walk.local("hdfs://x/y") is None


def test_hanging_and_dying_extractors_lose_their_file_only(spark, tmp_path):
    for name, text in {"1": "hang", "2": "die", "3": "none", "4": "the one\ntwo", "5": "", "6": "\udcff"}.items():
        (tmp_path / f"{name}.txt").write_bytes(text.encode("utf-8", "surrogateescape"))
    listed, began = files.scan(spark, str(tmp_path), "txt", content=False), time.monotonic()
    walk.manifest(listed, f"file://{tmp_path}/lists", 1, 1)
    found = extraction.read(spark, f"file://{tmp_path}/lists", extractor(), 1.0, "guarded").cache()
    got = sorted((r.doc_id[-5:-4], r.outcome, r.page_count, r.page_number, r.text) for r in found.collect())
    assert got == [("1", "timed_out", None, None, None), ("2", "error", None, None, None), ("3", "error", None, None, None), ("4", "ok", 2, 0, "the one"), ("4", "ok", 2, 1, "two"), ("5", "ok", 0, None, None), ("6", "error", None, None, None)]
    assert time.monotonic() - began < 120
    told = extraction.timed_out(found).collect()
    assert [(r.event_type, r.file_path[-5:]) for r in told] == [("operation.timed_out", "1.txt")]
    found.unpersist()


def test_files_that_went_after_the_scan(spark, tmp_path):
    lists = f"file://{tmp_path}/lists"
    walk.manifest(spark.createDataFrame([(f"file:{tmp_path}/gone.txt",)], "file_path string"), lists, 1, 1)
    assert [(r.outcome, r.page_number) for r in extraction.read(spark, lists, extractor()).collect()] == [("error", None)]
    assert extraction.read(spark, f"file://{tmp_path}/no_lists", extractor()).count() == 0


def test_a_stream_takes_the_lists_of_new_runs(spark, tree, tmp_path):
    lists, out = f"file://{tmp_path}/lists", str(tmp_path / "out")

    def run():
        stream = extraction.read(spark, lists, extractor(), short_name="streamed", stream=True)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
        query.processAllAvailable()
        query.stop()
        return sorted((os.path.basename(r.doc_id), r.text) for r in spark.read.schema(extraction.PAGE).parquet(out).filter("text IS NOT NULL").collect())

    first = files.scan(spark, str(tree), "txt", content=False)
    walk.manifest(first, lists, 1, 2)
    got = run()
    assert got == [("deep é%20.txt", "deep"), ("link.txt", "der the"), ("link.txt", "the"), ("one.txt", "der the"), ("one.txt", "the")]
    (tree / "new.txt").write_text("new")
    later = files.scan(spark, str(tree), "txt", content=False)
    walk.manifest(later.join(first.select("file_path"), "file_path", "left_anti").filter("file_name = 'new.txt'"), lists, 2, 2)
    (tmp_path / "lists" / "run=000000003").mkdir()  # a scan that was not finished
    assert run() == sorted(got + [("new.txt", "new")])


def test_highlights_over_boxes_from_files(spark, tree, tmp_path):
    lists = f"file://{tmp_path}/lists"
    walk.manifest(files.scan(spark, str(tree), "txt", content=False).filter("file_name = 'one.txt'"), lists, 1, 1)
    boxes = extraction.boxes(extraction.read(spark, lists, extractor()))
    got = sorted((r.page_number, r.term, r.x, r.y, r.w, r.h) for r in highlights.highlights(boxes, ["the"]).collect())
    assert got == [(0, "the", 0.1, 0.1, 0.08, 0.2), (1, "the", 0.0, 0.1, 0.08, 0.2)]


def test_pages_of_many_words_come_in_pieces():
    words = [(float(i), 0.0, i + 1.0, 1.0, f"w{i}", 0, 0, i) for i in range(150_000)]
    number, found = extraction._batches(iter([extraction.Page("first", 1.0, 1.0, iter(words)), extraction.Page("second"), extraction.Page("third", words=words[:extraction.PIECE])]))
    rows = [r for b in found for r in pa.ipc.read_record_batch(b, extraction._FOUND).to_pylist()]
    assert number == 3 and [(r["page_number"], r["piece"], r["text"], len(r["words"])) for r in rows] == [
        (0, 0, "first", 65536), (0, 1, None, 65536), (0, 2, None, 18928), (1, 0, "second", 0), (2, 0, "third", 65536),
    ]
    assert [w["word_no"] for r in rows[:3] for w in r["words"]] == list(range(150_000))
    assert extraction._batches([]) == (0, [])
