"""Native column helpers shared by the text operators."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code point ranges of the two word definitions (fixed values of the contracts).
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ASCII_SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

#: A null id takes the smallest value, so that it groups and joins like any other.
NULL_ID = -(2 ** 63)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay. Pure ASCII texts take the quick built-in."""
    return (F.when(F.octet_length(c) == F.length(c), F.lower(c))
            .otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase)))


def text_of(c: Column | str) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def alnum_words(lowered: Column) -> Column:
    """Runs of digits, a-z and non-ASCII characters of an already lower-cased text."""
    return F.array_remove(F.split(lowered, NOT_ALNUM), "")


def space_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, ASCII_SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    Catalyst may inline a projected column into a lambda that then evaluates
    it for every element; a lambda variable is bound once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def upto(n: Column) -> Column:
    """0 .. n-1, empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def row_key(id_col: str, text: Column) -> tuple[Column, Column]:
    """Key of a row: its id and a hash of its text.

    Rows that repeat an id with other texts stay apart; rows equal in both
    share every per-row result, so a join on the key keeps each of them.
    """
    return (F.coalesce(F.col(id_col), F.lit(NULL_ID).cast("long")).alias("__id"),
            F.xxhash64(text).alias("__th"))


def carried(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__row, __id, __th): whole rows with their keys; a struct keeps the rows' columns apart whatever their names."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *row_key(id_col, text_of(text_col)))


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows whose key is not in ``gone`` (__id, __th), with their columns unchanged."""
    return carried(docs, id_col, text_col).join(gone, ["__id", "__th"], "left_anti").select("__row.*")
