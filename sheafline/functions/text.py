"""Text expressions: trimming, words, lines, ids. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a word is a longest run of ASCII letters and digits of the lower-cased text.
WORD = "[a-z0-9]+"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Trim white space of any kind, as opposed to ``trim`` which only takes spaces."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def source_key(c: str | Column) -> Column:
    """Sources compare trimmed and lower-cased; blank ones count as absent."""
    key = F.lower(strip(c))
    return F.when(key != "", key)


def words(c: str | Column) -> Column:
    """All words in order, with repeats."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(WORD), F.lit(0))


def tokens(c: str | Column) -> Column:
    """Distinct words."""
    return F.array_distinct(words(c))


def lines(c: str | Column) -> Column:
    """Pieces between newline characters."""
    return F.split(col(c), "\n", -1)


def line_key(c: str | Column) -> Column:
    """Lines compare trimmed, lower-cased, with white-space runs as one space and digit runs equal."""
    spaced = F.regexp_replace(strip(c), r"(?U)\s+", " ")
    return F.regexp_replace(F.lower(spaced), r"\p{Nd}+", "0")


def short_hash(c: str | Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(col(c), 256), 1, 16)


def page_id(packet: str | Column, number: str | Column) -> Column:
    return F.format_string("%s_page_%04d", col(packet), col(number))


def document_id(packet: str | Column, number: str | Column) -> Column:
    return F.format_string("%s_doc_%03d", col(packet), col(number))


def chunk_id(document: str | Column, number: str | Column) -> Column:
    return F.format_string("%s_chunk_%03d", col(document), col(number))
