"""Word splitting, stripping, windows and previews as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as whitespace (those a Python ``str.split()`` splits on), as the inner
# part of a character class. With (?U), \s stands for all Unicode whitespace; the four separators are added.
WHITESPACE = r"\s\x1c-\x1f"

PREVIEW_CHARS = 160
TEXT_WINDOW = 300
TABLE_WINDOW = 200


def strip(col: Column) -> Column:
    return F.regexp_replace(col, rf"(?U)^[{WHITESPACE}]+|[{WHITESPACE}]+\z", "")


def not_blank(col: Column) -> Column:
    """False for NULL, for the empty string and for whitespace only; stops at the first visible character."""
    return F.coalesce(col.rlike(f"(?U)[^{WHITESPACE}]"), F.lit(False))


def single_spaced(col: Column) -> Column:
    """Words joined by one blank, none at the ends."""
    return F.trim(F.regexp_replace(col, f"(?U)[{WHITESPACE}]+", " "))


def words(col: Column) -> Column:
    """Array of the words; empty for blank text."""
    return F.filter(F.split(col, f"(?U)[{WHITESPACE}]+"), lambda w: w != "")


def word_windows(col: Column, size: int) -> Column:
    """Consecutive windows of ``size`` words, each joined by one blank.

    One possessive regular expression walks the text once, so the cost is linear in its length;
    slicing a word array once per window would be quadratic for very long texts.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    window = f"(?:[^ ]++ ){{0,{size - 1}}}+[^ ]++"
    return F.regexp_extract_all(single_spaced(col), F.lit(window), F.lit(0))


def preview(col: Column, chars: int = PREVIEW_CHARS) -> Column:
    return F.substring(col, 1, chars)


def chunk_key(source: Column, tag: Column, index: Column, chars: Column) -> Column:
    """Hex SHA-1 of ``source-tag-index-length``."""
    parts = [c.cast("string") for c in (source, tag, index, chars)]
    return F.sha1(F.concat_ws("-", *parts))


def readable_bytes(n: Column) -> Column:
    """1024-steps from B to TB with one decimal."""
    # The unit names.
    units = ["B", "KB", "MB", "GB", "TB"]
    value = n.cast("double")

    def shown(power: int) -> Column:
        # Round half to even on the exact value; the format alone would round half up.
        tenths = F.rint(value / float(1024**power) * 10.0) / 10.0
        return F.format_string("%.1f " + units[power], tenths)

    out = shown(len(units) - 1)
    for power in range(len(units) - 2, -1, -1):
        out = F.when(value < float(1024 ** (power + 1)), shown(power)).otherwise(out)
    return F.when(n.isNotNull(), out)


def title_case(col: Column) -> Column:
    """First letter of every run of letters in upper case, the others in lower case."""
    runs = F.regexp_extract_all(col, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), ""
    )


def csv_cell(value: Column) -> Column:
    """Quote-minimal CSV field; quotes are doubled."""
    text = F.coalesce(value, F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)


def csv_line(values: Column) -> Column:
    """One CSV line of an array of strings. A lone empty field is written as ``""`` so that it survives a read."""
    line = F.array_join(F.transform(values, csv_cell), ",")
    return F.when((F.size(values) == 1) & (line == ""), F.lit('""')).otherwise(line)
