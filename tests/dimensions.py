"""Small dimensions, modules and manifests that the tests know by heart."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Codes that the dimensions know; some languages and sources are left out, so that unmatched rows exist.
OBJECTS, DISCIPLINES, TYPES = ("EN", "FR"), tuple(f"D{i}" for i in range(0, 20, 2)), ("DTL", "SPC")
#: (category, alias, code, lang); the alias of two languages keeps the first row.
ALIASES = (
    ("objects", "DE", "EN", "en"), ("objects", "DE", "FR", "ru"), ("objects", "english", "EN", "en"), ("objects", "английский", "EN", "ru"), ("objects", "français", "FR", None),
    ("disciplines", "D1", "D0", "en"), ("disciplines", "D3", "D2", None), ("disciplines", "дисциплина", "D0", "ru"), ("disciplines", "discipline", "D4", "en"),
    ("documentTypes", "REG", "SPC", "ru"), ("documentTypes", "detail", "DTL", "en"), ("documentTypes", "чертёж", "DTL", "ru"),
)


def codes(spark: SparkSession) -> DataFrame:
    """(category, code)."""
    rows = [("objects", c) for c in OBJECTS] + [("disciplines", c) for c in DISCIPLINES] + [("documentTypes", c) for c in TYPES]
    return spark.createDataFrame(rows, "category string, code string")


def aliases(spark: SparkSession) -> DataFrame:
    """(category, alias, code, lang, seq), as listed: aliases may repeat."""
    return spark.createDataFrame([(*row, i) for i, row in enumerate(ALIASES)], "category string, alias string, code string, lang string, seq int")


#: (module_name, version, api_version, dependencies as (name, constraint)).
MODULES = (
    ("core", "1.4.0", "1.2", ()), ("tables", "0.9", "1.0", (("core", ">=1.1,<2"),)), ("drawings", "2.0.1", "2.0", (("core", ">=1.3"), ("tables", "==1.0"))),
    ("export", "1.0", "1.1", (("drawings", "<3"), ("missing", ">=1"))), ("stamps", "0.1", "1.0", (("core", "!=1.2"),)), ("audit", "3.x", "1.0", ()),
)


def modules(spark: SparkSession) -> DataFrame:
    """(module_name, version, api_version)."""
    return spark.createDataFrame([m[:3] for m in MODULES], "module_name string, version string, api_version string")


def dependencies(spark: SparkSession) -> DataFrame:
    """(module_name, needs, constraint)."""
    return spark.createDataFrame([(m[0], *d) for m in MODULES for d in m[3]], "module_name string, needs string, constraint string")


#: (module_name, core_constraint, libraries, path) of manifests; a name may have several.
MANIFESTS = (
    ("core", "", ("numpy",), "a/core"), ("tables", ">=1.2,<2", (), "a/tables"), ("drawings", ">=1", ("numpy", "nowhere"), "a/drawings"), ("export", "<=1.4", (), "a/export"),
    ("stamps", ">=2", ("nowhere",), "a/stamps"), ("audit", "==1.4", (), "a/audit"),
)


def manifests(spark: SparkSession) -> DataFrame:
    """The modules with what their manifests say; audit manages a table."""
    rows = spark.createDataFrame([(name, core, list(libraries), path) for name, core, libraries, path in MANIFESTS], "module_name string, core_constraint string, libraries array<string>, path string")
    own = F.when(F.col("module_name") == "audit", F.array(F.lit("notes"))).otherwise(F.array().cast("array<string>"))
    fixed = {"entry_point": F.lit("x:X"), "scan_phase": F.lit("secondary"), "description": F.lit(""), "managed_tables": own, "data_version": F.lit(1)}
    return modules(spark).join(rows, "module_name").withColumns(fixed)
