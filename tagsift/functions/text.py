"""Text column expressions: escaping, whitespace, words, spans (FN-01..09, FN-17, FN-23)."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

# Characters Python's str.isspace() accepts, as a regex class that Java and
# RE2 read the same way: the ASCII controls TAB..CR, the information
# separators U+001C..U+001F, U+0085 and the Unicode separators (Zs, Zl, Zp).
WS_CLASS = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}]"
# "Word" token: at least one letter or digit.
WORD_RE = r"[\p{L}\p{N}]"

TAB_ESCAPE = "\\t"          # the two characters backslash, t


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def unescape_text(text) -> Column:
    """FN-02: backslash-t -> TAB (unless the backslash is itself escaped), \\\\ -> \\, TAB -> space.

    The pattern consumes the character left of the escape, so in two adjacent
    escapes the second one survives (kept for parity, Q-13).
    """
    t = F.regexp_replace(_c(text), r"(^|[^\\]|\\\\)\\t", "$1\t")
    t = F.replace(t, F.lit("\\\\"), F.lit("\\"))
    return F.translate(t, "\t", " ")


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


@F.pandas_udf(ArrayType(LongType()))
def running_sums(values):
    """Sums of an array's numbers up to and with each (no SQL built-in makes them in one pass)."""
    return values.map(lambda v: None if v is None else np.cumsum(v))


@F.pandas_udf(ArrayType(IntegerType()))
def numbers_below(values, limits):
    """For each of an array of limits, how many numbers of an ascending array are below it."""
    return pd.Series([None if v is None or x is None else np.searchsorted(v, x) for v, x in zip(values, limits)], dtype=object)


def texts_of(values) -> list:
    """The strings of an Arrow array; bytes that are no UTF-8 become U+FFFD, as in the JVM."""
    try:
        return values.to_pylist()
    except UnicodeDecodeError:
        plain = lambda x: None if x is None else [plain(y) for y in x] if isinstance(x, list) else x.decode("utf-8", "replace")
        return plain(values.cast(pa.list_(pa.binary()) if pa.types.is_list(values.type) else pa.binary()).to_pylist())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@functools.cache
def letters_and_digits() -> np.ndarray:
    """By code point: whether it is one of WORD_RE."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)), bool, 0x110000)


@functools.cache
def white_space() -> np.ndarray:
    """By code point: whether it is one of WS_CLASS."""
    return np.fromiter((chr(c).isspace() for c in range(0x110000)), bool, 0x110000)


def white_tokens(text: str) -> tuple[list[str], np.ndarray]:
    """The runs between white space (WS_CLASS), and their places."""
    gap = white_space()[code_points(text)]
    return text.split(), np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))


def gapped_words(text: Column, gap: str, word: str) -> Column:
    """Matches of ``word`` in order (run), each with the number of characters since the one before it (gap).

    ``gap`` is a possessive pattern of what stands between words; the last match, the rest without a word, is dropped.
    """
    cut = F.lit(rf"(?s){gap}({word}|\z)")
    both = F.arrays_zip(F.regexp_extract_all(text, cut, 1).alias("run"), F.regexp_extract_all(text, cut, 0).alias("all"))
    return F.transform(F.filter(both, lambda x: x["run"] != ""), lambda x: F.struct(
        (F.length(x["all"]) - F.length(x["run"])).alias("gap"), x["run"].alias("run")))


def in_turns(copies: Column) -> Column:
    """Arrays of one key as one: their first elements one after the other, then their second ones ..."""
    places = F.sequence(F.lit(0), F.array_max(F.transform(copies, F.size)) - 1)
    turns = F.flatten(F.transform(places, lambda i: F.filter(F.transform(copies, lambda c: F.get(c, i)), lambda x: x.isNotNull())))
    return F.when(F.size(copies) == 1, F.get(copies, F.lit(0))).when(F.exists(copies, lambda c: F.size(c) > 0), turns)


def words_in_turns(copies: Column) -> Column:
    """``in_turns`` of ``gapped_words``; the gaps of the n-th words all come before the first of them."""
    def at(i: Column) -> Column:
        here = F.filter(F.transform(copies, lambda c: F.get(c, i)), lambda x: x.isNotNull())
        gaps = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x["gap"])
        return bind(here, lambda xs: F.transform(xs, lambda x, j: F.struct(
            F.when(j == 0, gaps(xs)).otherwise(0).alias("gap"), x["run"].alias("run"))))

    places = F.sequence(F.lit(0), F.array_max(F.transform(copies, F.size)) - 1)
    none = F.slice(F.get(copies, F.lit(0)), F.lit(1), F.lit(0))
    return F.when(F.size(copies) == 1, F.get(copies, F.lit(0))).when(
        F.exists(copies, lambda c: F.size(c) > 0), F.flatten(F.transform(places, at))).otherwise(none)


def normalize_space(s) -> Column:
    """FN-06: runs of (Python) whitespace -> one space, trimmed."""
    return F.trim(F.regexp_replace(_c(s), WS_CLASS + "+", " "))


def parse_tag(tag) -> tuple[Column, Column]:
    """FN-23: 'B-TYPE' -> ('B', 'TYPE'), split at the first '-'; no '-' -> (tag, '')."""
    t = _c(tag)
    pos = F.instr(t, "-")
    prefix = F.when(pos > 0, F.substring_index(t, "-", 1)).otherwise(t)
    typ = F.when(pos > 0, F.substr(t, pos + 1)).otherwise(F.lit(""))
    return prefix, typ


def clean_phrase(p, legacy: bool = True) -> Column:
    """FN-17: lower-case and remove determiners.

    ``legacy`` removes the substrings anywhere, in order ('alpha beta' loses its
    'a '), as the reference does; otherwise only whole words are removed.
    """
    s = F.lower(_c(p))
    # The removed words, in the reference's order.
    words = ["this ", "that ", "those ", "these ", "the ", "a ", "other "]
    for w in words:
        if legacy:
            s = F.replace(s, F.lit(w), F.lit(""))
        else:
            s = F.regexp_replace(s, r"\b" + w.strip() + r" ", "")
    return s
