"""Column expressions for loosely typed payload values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def nonempty(c: Column) -> Column:
    """The text, or null when it is empty."""
    return F.nullif(c, F.lit(""))


def first_truthy(*cols: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[nonempty(c) for c in cols])


def computed_once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns behind a one-row generator.

    Filters on plain projected columns are pushed below the projection together with
    their expressions, which are then evaluated again above; costly parsing is not
    worth that.
    """
    others = [c for c in rows.columns if c not in columns]
    return rows.select(*others, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def truthy_id(c: Column) -> Column:
    """An identifier, or null when it is empty, zero or false."""
    return F.when(~F.coalesce(c, F.lit("")).isin("", "0", "false"), c)


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(" \t\n\r\f\v\u00a0"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def number(c: Column) -> Column:
    """Number read from text; white space is 0, empty or unreadable text is null.

    Kept short because callers repeat it: the cast trims and rejects by itself, the
    pattern only shuts out words such as 'NaN' and suffixes such as '1d'.
    """
    return F.when(c.rlike(NUMERIC_TEXT), c.try_cast("double")).when(c.rlike(r"^\s+$"), F.lit(0.0))


def whole_non_negative(c: Column) -> Column:
    """Truncated towards zero; null when negative, unreadable or beyond the integer range."""
    whole = number(c).try_cast("int")
    return F.when(whole >= 0, whole)


def money_non_negative(c: Column) -> Column:
    n = number(c)
    return F.when(n >= 0, n.try_cast("decimal(12,2)"))


def present(c: Column) -> Column:
    """Neither null nor the empty string."""
    return c.isNotNull() & (c.cast("string") != "")


def is_ymd(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))


def map_put(m: Column, key: str, value: Column) -> Column:
    """Map with ``key`` set to ``value``, replacing an older entry."""
    rest = F.map_filter(m, lambda k, _: k != F.lit(key))
    return F.map_concat(rest, F.create_map(F.lit(key), value.cast("string")))


def json_map(c: Column) -> Column:
    """JSON object text as ``map<string,string>``; an empty map when absent."""
    parsed = F.from_json(c, "map<string,string>")
    return F.coalesce(parsed, F.from_json(F.lit("{}"), "map<string,string>"))
