"""Scalar column functions.

Each takes Columns (or column names) and returns a Column, so it stays inside
whole-stage code generation.  Where the original filter had a Python quirk,
the chosen behaviour is stated on the function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimscope import definitions as D

__all__ = [
    "col_of", "to_double", "multiply", "mul", "div", "abs_or_zero", "abs_or_same",
    "get_item", "get_keys", "to_matrix", "zip_lists", "in_list", "isin_text",
    "equals_text", "dict_sum", "money_text", "number_text", "date_text",
    "capfirst", "title", "key_title", "amount_from_text", "mask_member",
    "default_text", "status_from_flag",
]


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c) -> Column:
    """float(value): numbers and numeric text; anything else null."""
    return F.trim(col_of(c).cast("string")).try_cast("double")


def multiply(value, arg) -> Column:
    """float(value) * float(arg); bad input -> 0."""
    return F.coalesce(to_double(value) * to_double(arg), F.lit(0.0))


def mul(value, arg) -> Column:
    """As :func:`multiply` (the null-raises quirk is not kept)."""
    return multiply(value, arg)


def div(value, arg) -> Column:
    """Value / arg, 0 when arg is falsy, zero or not a number."""
    return F.coalesce(F.try_divide(to_double(value), F.nullif(to_double(arg), F.lit(0.0))),
                      F.lit(0.0))


def abs_or_zero(value) -> Column:
    """X4 ``abs`` / ``abs_val``: |float(value)|, bad -> 0."""
    return F.coalesce(F.abs(to_double(value)), F.lit(0.0))


def abs_or_same(value) -> Column:
    """X5 ``absval``: |float(value)| as text, bad input returned unchanged."""
    v = col_of(value)
    return F.coalesce(F.abs(to_double(v)).cast("string"), v.cast("string"))


def get_item(mapping, key) -> Column:
    """Map lookup, null when the key or the map is missing."""
    return F.try_element_at(col_of(mapping), key if isinstance(key, Column) else F.lit(key))


def get_keys(mapping) -> Column:
    """Keys of a map, empty array for null."""
    return F.coalesce(F.map_keys(col_of(mapping)), F.array().cast("array<string>"))


def to_matrix(mapping) -> Column:
    """Map of maps -> list of rows in key order, missing cells 0."""
    m = col_of(mapping)
    keys = F.map_keys(m)
    return F.transform(keys, lambda k: F.transform(
        keys, lambda j: F.coalesce(F.try_element_at(F.try_element_at(m, k), j), F.lit(0.0))))


def zip_lists(a, b) -> Column:
    """Pair two arrays element-wise (the intent of ``zip``)."""
    return F.arrays_zip(col_of(a), col_of(b))


def _options(arg: str) -> Column:
    return F.transform(F.split(F.lit(arg), ","), lambda x: F.upper(F.trim(x)))


def in_list(value, arg: str) -> Column:
    """F12 ``in_list``: upper(str(value)) in trimmed upper comma list; null -> false."""
    v = col_of(value)
    return F.coalesce(F.array_contains(_options(arg), F.upper(v.cast("string"))), F.lit(False))


def isin_text(value, arg: str) -> Column:
    """F12 ``isin``: as :func:`in_list` but also false on empty text."""
    v = col_of(value).cast("string")
    return F.when(F.coalesce(v, F.lit("")) == "", F.lit(False)).otherwise(
        F.coalesce(F.array_contains(_options(arg), F.upper(v)), F.lit(False)))


def equals_text(a, b) -> Column:
    """F13 ``equals``: str(a) == str(b); two nulls are equal (both 'None')."""
    return col_of(a).cast("string").eqNullSafe(col_of(b).cast("string"))


def dict_sum(map_of_maps, key: str) -> Column:
    """A25 ``dictsum``: sum of one key over the inner maps, missing -> 0."""
    m = col_of(map_of_maps)
    return F.aggregate(F.map_values(m), F.lit(0.0),
                       lambda acc, inner: acc + F.coalesce(
                           F.try_element_at(inner, F.lit(key)).cast("double"), F.lit(0.0)))


def number_text(x, decimals: int = 2) -> Column:
    """X11 ``floatformat:n|intcomma``: grouped thousands, n decimals, ties
    away from zero (``format_number`` alone would round them to even)."""
    return F.format_number(F.round(col_of(x).cast("double"), decimals), decimals)


def money_text(x, decimals: int = 2) -> Column:
    """X11: ``KES 1,234.50``."""
    return F.concat(F.lit(D.CURRENCY_PREFIX), number_text(x, decimals))


_DATE_FORMATS = {"Y-m": "yyyy-MM", "Y": "yyyy", "F": "MMMM", "Y-m-d": "yyyy-MM-dd"}


def date_text(d, fmt: str = "Y-m-d") -> Column:
    """Template date formats ``Y-m``, ``Y``, ``F`` (month name), ``Y-m-d``."""
    return F.date_format(col_of(d), _DATE_FORMATS[fmt])


def capfirst(s) -> Column:
    """X13 ``capfirst``: first character upper, the rest unchanged."""
    c = col_of(s).cast("string")
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def title(s) -> Column:
    """X13 ``title``: words capitalised."""
    return F.initcap(col_of(s).cast("string"))


def _span(n: Column, start: int | None, stop: int | None) -> tuple[Column, Column]:
    """1-based begin and length of ``start:stop`` of ``n`` items, as Python
    counts them (negative from the end)."""
    at = lambda i: F.least(F.lit(i), n) if i >= 0 else F.greatest(n + F.lit(i), F.lit(0))
    a, b = at(start or 0), n if stop is None else at(stop)
    return a + 1, F.greatest(b - a, F.lit(0))


def slice_text(s, start: int | None = None, stop: int | None = None) -> Column:
    """X13 ``slice`` of a text: characters ``start:stop``."""
    c = col_of(s).cast("string")
    return F.substring(c, *_span(F.length(c), start, stop))


def slice_list(values, start: int | None = None, stop: int | None = None) -> Column:
    """X13 ``slice`` of an array: items ``start:stop``."""
    c = col_of(values)
    return F.slice(c, *_span(F.size(c), start, stop))


def join_list(values, sep: str = ", ") -> Column:
    """X13 ``join``: the items as text; a missing one is ``None``."""
    return F.array_join(F.transform(col_of(values), lambda v: v.cast("string")), sep, "None")


def length_text(s) -> Column:
    """X13 ``length`` of a text; 0 for null."""
    return F.coalesce(F.length(col_of(s).cast("string")), F.lit(0))


def length_list(values) -> Column:
    """X13 ``length`` of an array or a map; 0 for null."""
    c = col_of(values)
    return F.when(c.isNull(), F.lit(0)).otherwise(F.size(c))


def upper(s) -> Column:
    """X13 ``upper``."""
    return F.upper(col_of(s).cast("string"))


def key_title(key, titles: dict[str, str] | None = None) -> Column:
    """Mapped title, else '_' -> ' ' and words capitalised."""
    titles = D.KEY_TITLES if titles is None else titles
    k = col_of(key)
    pairs = []
    for name, text in titles.items():
        pairs += [F.lit(name), F.lit(text)]
    mapped = F.try_element_at(F.create_map(*pairs), k) if pairs else F.lit(None)
    return F.coalesce(mapped, F.initcap(F.regexp_replace(k, "_", " ")))


def amount_from_text(s) -> Column:
    """Keep digits, '.', '-' and read a number; bad -> null."""
    return F.regexp_replace(col_of(s).cast("string"), r"[^0-9.\-]+", "").try_cast("double")


def mask_member(member) -> Column:
    """F16: first four characters then ``****``."""
    return F.concat(F.substring(col_of(member).cast("string"), 1, D.MASK_KEEP),
                    F.lit(D.MASK_SUFFIX))


def default_text(c, default: str = "N/A") -> Column:
    """the template ``default``: null, '' and the number 0 (in any
    scale) are replaced; the text ``"0"`` is not."""
    col = col_of(c)
    v = col.cast("string")
    falsy = F.typeof(col).isin("string", "varchar", "char", "date", "timestamp")
    return F.when(v.isNull() | (v == "") | (~falsy & (v.try_cast("double") == 0)) | (v == "false"), F.lit(default)).otherwise(v)


def status_from_flag(flag) -> Column:
    """``Flagged`` when the fraud flag is true, else ``Approved``."""
    return F.when(F.coalesce(col_of(flag), F.lit(False)), "Flagged").otherwise("Approved")
