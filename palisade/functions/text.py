"""Text functions shared by the detectors, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_WIDTH = "​‌‍﻿"
RTL_OVERRIDE = "‮"


def fold_ascii(text: Column) -> Column:
    """A-Z in lower case. lower() is used for its speed; the two letters outside ASCII whose lower case holds ASCII
    letters (the Kelvin sign and the dotted capital I) are first replaced by one whose lower case does not."""
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("Å")), F.lit("İ"), F.lit("Å")))


def valid_text(content: Column) -> Column:
    """Text of UTF-8 bytes, null where they are not valid."""
    as_text = content.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text)


def lossy_text(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def lines(text: Column) -> Column:
    """Lines parted by \\n, each without one trailing \\r; an empty end after the last \\n is no line."""
    parts = F.split(text, "\r?\n")
    last_empty = F.element_at(parts, -1) == ""
    return F.when(last_empty, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def cut_utf8(text: Column, n_bytes: int) -> Column:
    """The longest prefix of at most n_bytes bytes that ends at a character's border."""
    raw = F.substring(text.cast("binary"), 1, n_bytes)
    cut = lambda k: F.substring(text.cast("binary"), 1, n_bytes - k).cast("string")
    whole = F.octet_length(text) <= n_bytes
    return F.when(whole, text).when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).when(F.is_valid_utf8(cut(1)), cut(1)).when(F.is_valid_utf8(cut(2)), cut(2)).otherwise(cut(3))


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def slug(category: Column) -> Column:
    return F.replace(F.replace(category, F.lit(" · "), F.lit("_")), F.lit(" "), F.lit("_"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; '' for names without one and for names that only start with one."""
    return F.regexp_extract(base_name(path), "^.+\\.([^.]*)$", 1)
