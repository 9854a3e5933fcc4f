"""Column expressions shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: space and U+0009 to U+000D
SPACES = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    The optimiser may inline a projected column into the body of a lambda,
    where it would be computed again for every array element. A lambda's own
    argument is bound instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def whole(text: Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def space_words(text: Column) -> Column:
    """Runs of anything but the characters of SPACES, as an array in text order."""
    trimmed = F.btrim(text, F.lit(SPACES))
    none = F.array().cast("array<string>")
    return F.when(trimmed == "", none).otherwise(F.split(trimmed, "[ \\t-\\r]+", -1))


def with_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Append columns; an input column of the same name (in any case) is replaced."""
    taken = {name.lower() for name in columns}
    kept = [quoted(c) for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *[value.alias(name) for name, value in columns.items()])


def quoted(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")
