"""Text functions as column expressions: look-alike folding, tokens, patterns, file names, versions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cyrillic letters and the Latin letters that look like them.
CYRILLIC = "авекмнорстух"
LATIN = "abekmhopctyx"
#: Runs of letters, digits and private-use characters; combining marks are dropped before.
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
#: Around matches in a snippet; upper case, so that denormalising leaves them alone.
MARK_START, MARK_END = "[[MATCH_START]]", "[[MATCH_END]]"
WHITE = " \t\n\x0b\x0c\r"
#: Fixed value: six dash-separated parts, the sixth beginning with a revision letter or digit.
FILE_NAME = r"^([^\s-]+)-([^\s-]+)-([^\s-]+)-([^\s-]+)-([^\s-]+)-([A-Za-z0-9])(.*)$"


def normalize_text(text: Column) -> Column:
    """Lower case with Cyrillic look-alikes as Latin letters."""
    return F.translate(F.lower(text), CYRILLIC, LATIN)


def denormalize_text(text: Column) -> Column:
    """The reverse mapping; real Latin letters become Cyrillic too."""
    return F.translate(text, LATIN, CYRILLIC)


@lru_cache
def accents() -> tuple[str, str]:
    """Lower-case Latin letters with one accent, and their base letters."""
    pairs = [(chr(c), d[0]) for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(c))) == 2 and d[0].isascii() and d[0].islower()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without accents on Latin letters; other scripts keep theirs."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}", ""), *accents())


def tokens(text: Column) -> Column:
    """The tokens of a text; a null text has none."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def like_ascii(value: Column, pattern: str) -> Column:
    """LIKE that ignores case for A-Z only; no escape character."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    folded = "".join(c.lower() if c.isascii() else c for c in pattern)
    regex = "".join(".*" if c == "%" else "." if c == "_" else "\\" + c if not c.isalnum() and c.isascii() else c for c in folded)
    return F.rlike(F.translate(value, upper, lower), F.lit(f"(?s)^{regex}\\z"))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def snippet_terms(snippet: Column) -> Column:
    """Different texts between marks in order, stripped; unpaired marks and blank texts give none."""
    inner = r"(?s)\Q" + MARK_START + r"\E(.*?)\Q" + MARK_END + r"\E"
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(snippet, F.lit(inner), F.lit(1)), strip), lambda x: x != ""))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """The file name without its last extension; a leading dot begins no extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def parsed_file_name(path: Column) -> dict[str, Column]:
    """is_valid, object_code, discipline_code and document_type_code; null codes if the name doesn't fit."""
    stem = file_stem(path)
    valid = F.coalesce(F.rlike(stem, F.lit(FILE_NAME)), F.lit(False))
    part = lambda i: F.when(valid, F.regexp_extract(stem, FILE_NAME, i))
    return {"is_valid": valid, "object_code": part(2), "discipline_code": part(3), "document_type_code": part(4)}


def version_parts(version: Column) -> Column:
    """Numbers of a dotted version; parts that are no numbers count 0."""
    return F.transform(F.split(version, r"\."), lambda x: F.coalesce(F.trim(x).try_cast("int"), F.lit(0)))


def version_fits(version: Column, constraint: Column) -> Column:
    """Whether a version meets every comma-separated part of a constraint; no operator means equality, blank parts hold."""
    have = version_parts(version)

    def fits(part: Column) -> Column:
        part = F.trim(part)
        op = F.regexp_extract(part, r"^(>=|<=|!=|==|>|<)?", 0)
        want = version_parts(F.regexp_replace(part, r"^(>=|<=|!=|==|>|<)?\s*", ""))
        return (
            F.when(part == "", True).when(op.isin("", "=="), have == want).when(op == "!=", have != want)
            .when(op == ">=", have >= want).when(op == "<=", have <= want).when(op == ">", have > want).otherwise(have < want)
        )

    return F.forall(F.split(constraint, ","), fits)


def percent(done: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(done / total * 100)


def effective_dpi(dpi: Column, width_pt: Column, height_pt: Column, max_pixels: int = 20_000_000, least: int = 72) -> Column:
    """Resolution that keeps a page within ``max_pixels``; null below ``least``."""
    pixels = (width_pt * dpi / 72) * (height_pt * dpi / 72)
    shrunk = F.when(pixels > max_pixels, F.floor(dpi * F.sqrt(F.lit(max_pixels) / pixels))).otherwise(dpi)
    return F.when(shrunk >= least, shrunk).cast("int")


def field_value(text: Column) -> Column:
    """Lower case with runs of white space as one space, stripped."""
    return strip(F.regexp_replace(F.lower(text), r"\s+", " "))


def safe_id(text: Column, length: int = 64) -> Column:
    return F.left(F.regexp_replace(text, "[^a-zA-Z0-9_-]", "_"), F.lit(length))


def new_id() -> Column:
    """A random id in the form of a UUID."""
    return F.expr("uuid()")


def stable_id(*parts: Column) -> Column:
    """An id in the form of a UUID that follows from ``parts``; null parts differ from empty ones."""
    told = [F.coalesce(F.concat(F.lit("="), x.cast("string")), F.lit("")) for x in parts]
    digest = F.md5(F.concat_ws("\n", *told).cast("binary"))
    return F.concat_ws("-", *(F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
