import re

import pytest
from pyspark.sql import functions as F

from leafmark.functions import text as T


def one(spark, column, *values):
    return spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(column).head()[0]


@pytest.mark.parametrize("raw, normal", [("ДОМ", "дom"), ("ЕС-423-1", "ec-423-1"), ("Пример текста", "пpиmep tekcta"), ("дбгж", "дбгж"), ("123-456.789!", "123-456.789!")])
def test_normalize(spark, raw, normal):
    assert one(spark, T.normalize_text(F.col("c0")), raw) == normal
    assert one(spark, T.normalize_text(T.normalize_text(F.col("c0"))), raw) == normal


@pytest.mark.parametrize("normal, raw", [("ec-423-1", "ес-423-1"), ("пример texta", "пример техта"), ("zqwf", "zqwf")])
def test_denormalize(spark, normal, raw):
    assert one(spark, T.denormalize_text(F.col("c0")), normal) == raw


@pytest.mark.parametrize(
    "path, parts",
    [
        ("x/1800-7350-265-DTL-007-5 - копия.pdf", ("7350", "265", "DTL")), ("1800-7350-265-DTL-007-A", ("7350", "265", "DTL")), ("notes_7.pdf", None), ("a-b-c-d-e-.pdf", None), ("a-b-c-d-e.pdf", None), ("", None),
        ("a-b-c-d-e-f.1.pdf", ("b", "c", "d")),
    ],
)
def test_file_names(spark, path, parts):
    p = T.parsed_file_name(F.col("c0"))
    got = spark.createDataFrame([(path,)], "c0 string").select(*(c.alias(n) for n, c in p.items())).head()
    assert got.is_valid == (parts is not None) and tuple(got)[1:] == (parts or (None, None, None))


@pytest.mark.parametrize("version, constraint, fits", [("1.0", ">=1.0.0", False), ("1.0.0", ">=1.0", True), ("1.2", ">=1.1,<2", True), ("2.0", ">=1.1,<2", False), ("3.x", "==3.0", True), ("1.0", "1.0", True), ("1", "!=1", False), ("1.10", ">1.9", True), ("1", "", True), ("1", "<=0.9", False)])
def test_versions(spark, version, constraint, fits):
    assert one(spark, T.version_fits(F.col("c0"), F.col("c1")), version, constraint) == fits


def test_small_functions(spark):
    assert one(spark, T.field_value(F.col("c0")), "  Ab\t c ") == "ab c"
    assert one(spark, T.safe_id(F.col("c0"), 4), "a b/c-d") == "a_b_"
    assert spark.range(1).select(T.percent(F.lit(1), F.lit(4)), T.percent(F.lit(1), F.lit(0))).head()[:] == (25.0, 0.0)
    assert spark.range(1).select(T.effective_dpi(F.lit(300), F.lit(595), F.lit(842)), T.effective_dpi(F.lit(300), F.lit(72000), F.lit(72000))).head()[:] == (300, None)


def test_null_texts(spark):
    row = spark.createDataFrame([(None,)], "c string").select(T.tokens(F.col("c")), T.normalize_text(F.col("c"))).head()
    assert row[0] == [] and row[1] is None


def test_ids(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None), ("a", ""), ("a\n=b", None)], "x string, y string")
    ids = [r[0] for r in df.select(T.stable_id(F.col("x"), F.col("y"))).collect()]
    assert len(set(ids)) == 4 and all(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", i) for i in ids)
    assert df.select(T.new_id().alias("i")).distinct().count() == 4
