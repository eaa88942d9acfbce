"""Column expressions on text. All run in the JVM; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The script kept by default, and the control characters that
# table files must not hold.
HAN = r"一-龥"
CONTROLS = r"[\x00-\x08\x0B-\x0C\x0E-\x1F]"

# What str.split() takes as white space; `\s` alone covers only ASCII.
BLANKS = r"[\t-\r\x1c-\x1f\x85\p{Z}]+"


def keep_script(text: Column, char_class: str = HAN, repl: str = "") -> Column:
    """Drop every character outside ``char_class``; null becomes empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"[^{char_class}]", repl)


def without_controls(text: Column) -> Column:
    """Drop control characters except tab, line feed and carriage return."""
    return F.regexp_replace(text, CONTROLS, "")


def strip_controls(df: DataFrame) -> DataFrame:
    """``without_controls`` on every string column; other types are untouched."""
    return df.select([
        without_controls(F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def split_blanks(text: Column) -> Column:
    """Tokens of white-space separated text."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def join_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def letter_tokens(text: Column, lower: bool = True) -> Column:
    """Runs of letters."""
    return _all(F.lower(text) if lower else text, r"\p{L}+", 0)


def raw_tokens(text: Column, lower: bool = True) -> Column:
    """Runs of letters, and every other character as a token of its own."""
    return _all(F.lower(text) if lower else text, r"\p{L}+|\P{L}", 0)


def ngram_tokens(text: Column, n: int = 2, char_class: str = HAN) -> Column:
    """Overlapping ``n``-grams inside runs of ``char_class``.

    The look-ahead captures the n-gram while the match itself takes a single
    character, so a text is read once, whatever its length.
    """
    return _all(text, f"(?=([{char_class}]{{{n}}}))[{char_class}]", 1)


def windows(text: Column, size: int) -> Column:
    """For each position the next ``size`` characters (fewer at the end)."""
    return _all(text, f"(?s)(?=(.{{1,{size}}})).", 1)


def _all(text: Column, pattern: str, group: int) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def or_missing(col: Column) -> Column:
    """Text form of a value, with null as ``missing``."""
    return F.coalesce(col.cast("string"), F.lit("missing"))
