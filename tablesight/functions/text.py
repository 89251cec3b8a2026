"""Small text expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: every character that splits words, Unicode spaces included. Readable by Java's and by
# RE2-style regular expressions alike.
SPACE_CLASS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
# Any other character: a text has words where it has one.
NOT_SPACE = "[^" + SPACE_CLASS[1:-1]


def words(text: Column) -> Column:
    """Words of a text, split at any run of white space."""
    return F.array_remove(F.split(text, SPACE_CLASS), "")


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit(""))))


def contains_any(text: Column, needles) -> Column:
    """True when any of a fixed list of strings occurs in the text."""
    result = F.lit(False)
    for needle in needles:
        result = result | F.contains(text, F.lit(needle))
    return result


def suffix(path: Column) -> Column:
    """Lower-cased extension with its dot, empty when there is none.

    As with file names anywhere, a leading dot does not start an extension.
    """
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^./\\]+)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^./\\]+$", "")


def slug(text: Column, limit: int = 50, default: str = "orchestration_request") -> Column:
    """File-name form of a request: word characters only, blanks as underscores, cut to ``limit``."""
    cleaned = F.regexp_replace(F.lower(text), r"(?U)[^\w\s-]", "")
    joined = F.regexp_replace(F.trim(cleaned), r"(?U)\s+", "_")
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit(default)).otherwise(F.left(joined, F.lit(limit)))


def report_file_name(title: Column) -> Column:
    """HTML file name for a report title."""
    base = F.regexp_replace(
        F.regexp_replace(F.lower(F.trim(F.coalesce(title, F.lit("")))), r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(base != "", F.concat(base, F.lit(".html"))).otherwise(F.lit("report.html"))


def letters_and_digits(text: Column) -> Column:
    """Key for matching headings that differ only in case, blanks and punctuation."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")
