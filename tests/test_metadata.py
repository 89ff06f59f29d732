import json

from leafmark.operators import metadata
from leafmark.sources import files, tables
from tests import dimensions


def test_resolution(spark):
    docs = spark.createDataFrame([("p/1-EN-D0-DTL-1-A.pdf",), ("p/1-DE-D1-REG-1-A.pdf",), ("p/1-ES-D0-DTL-1-A.pdf",), ("p/notes.pdf",)], "file_path string")
    r = {x.file_path[2:6]: (x.object_code, x.discipline_code, x.document_type_code, x.unmatched_flag) for x in metadata.resolve(docs, dimensions.codes(spark), dimensions.aliases(spark)).collect()}
    assert r == {"1-EN": ("EN", "D0", "DTL", 0), "1-DE": ("EN", "D0", "SPC", 0), "1-ES": (None, "D0", "DTL", 1), "note": (None, None, None, 1)}


def test_suggestions(spark):
    s = lambda c, t: [tuple(r) for r in metadata.suggest(dimensions.codes(spark), dimensions.aliases(spark), c, t).collect()]
    assert s("objects", "en") == [("EN", "английский", "EN", True)]
    assert s("objects", "eng") == [("english", "EN", "EN", False)]
    assert s("objects", " АНГ") == [("английский", "EN", "EN", False)]
    assert s("objects", " ") == [] and s("disciplines", "disc") == [("discipline", "D4", "D4", False)]


def test_reference_file(spark, tmp_path):
    good = {
        "objects": {"codes": ["A", " ", "B "], "aliases_en": [{"alias": "x", "code": "A"}, {"alias": "", "code": "A"}], "aliases_ru": [{"alias": "x", "code": "B"}, {"alias": "y", "code": "B"}, {"alias": "z", "code": "Q"}]},
        "disciplines": {"codes": [], "aliases_en": [], "aliases_ru": []}, "documentTypes": {"codes": ["T"], "aliases_en": [], "aliases_ru": []},
    }
    (tmp_path / "good.json").write_text(json.dumps(good))
    codes, aliases = files.references(spark, str(tmp_path / "good.json"))
    assert sorted(tuple(r) for r in codes.collect()) == [("documentTypes", "T"), ("objects", "A"), ("objects", "B")]
    assert sorted((r.alias, r.code, r.lang) for r in aliases.collect()) == [("x", "A", "en"), ("y", "B", "ru")]
    del good["disciplines"]["codes"]
    (tmp_path / "bad.json").write_text(json.dumps(good))
    codes, aliases = files.references(spark, str(tmp_path / "bad.json"))
    assert codes.isEmpty() and aliases.isEmpty()


def test_folder_scan_and_pages(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.PDF").write_bytes(b"one\ftwo \f")
    (tmp_path / "in" / "sub" / "b.pdf").write_bytes(b"")
    (tmp_path / "in" / "c.txt").write_bytes(b"no")
    found = files.scan(spark, str(tmp_path / "in"))
    rows = {r.relative_path: r for r in found.collect()}
    assert rows.keys() == {"a.PDF", "sub/b.pdf"} and rows["sub/b.pdf"].file_hash is None and rows["a.PDF"].file_size == 9
    assert "content" not in files.scan(spark, str(tmp_path / "in"), content=False).columns
    pages = files.extract_pages(found.selectExpr("file_name AS doc_id", "content"))
    assert sorted((r.doc_id, r.page_count, r.page_number, r.text) for r in pages.collect()) == [("a.PDF", 3, 0, "one"), ("a.PDF", 3, 1, "two"), ("a.PDF", 3, 2, ""), ("b.pdf", 1, 0, "")]

    def broken(data):
        raise RuntimeError("not a document")

    assert [r.text for r in files.extract_pages(found.selectExpr("file_name AS doc_id", "content"), broken).collect()] == [None, None]


def test_missing_folder_has_no_files(spark, tmp_path):
    assert files.scan(spark, str(tmp_path / "nowhere")).isEmpty()
