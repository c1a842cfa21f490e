"""Case folding, observed values and the three ways to read a JSON field."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(c: Column | str) -> Column:
    """Case-insensitive form of a text."""
    return F.lower(F.col(c) if isinstance(c, str) else c)


def contains(c: Column, text: str) -> Column:
    return F.contains(fold(c), fold(F.lit(text)))


def equals(c: Column, text: str) -> Column:
    return fold(c) == fold(F.lit(text))


def starts_with(c: Column, text: str) -> Column:
    return F.startswith(fold(c), fold(F.lit(text)))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


def observed(columns: list[Column]) -> Column:
    """Whether one of the values is neither null, empty nor 0."""
    return any_of([c.isNotNull() & ~c.cast("string").isin("", "0") for c in columns])


def not_equals(columns: list[Column], text: str) -> Column:
    """Observed, and no column has the text."""
    return observed(columns) & ~any_of([equals(F.coalesce(c.cast("string"), F.lit("")), text) for c in columns])


def safe_object(doc: str) -> Column:
    """The document, or null where it isn't a JSON object."""
    return F.when(F.json_object_keys(doc).isNotNull(), F.col(doc))


def json_value(doc: str, path: str) -> Column:
    """First value at a dotted path of a safe document, as text."""
    return F.get_json_object(safe_object(doc), f"$.{path}")


def json_scalar_text(doc: str, key: str) -> Column:
    """The key's text if it occurs exactly once and is a string; else null."""
    once = F.size(F.filter(F.json_object_keys(doc), lambda k: k == key)) == 1
    variant = F.from_json(doc, "map<string,variant>")[key]
    return F.when(once & (F.schema_of_variant(variant) == "STRING"), F.try_variant_get(variant, "$", "string"))


def json_scalar_bigint(doc: str, key: str, low: int, high: int) -> Column:
    """The key's integer if it occurs exactly once, is an integer and lies within bounds; else null."""
    once = F.size(F.filter(F.json_object_keys(doc), lambda k: k == key)) == 1
    variant = F.from_json(doc, "map<string,variant>")[key]
    value = F.try_variant_get(variant, "$", "bigint")
    return F.when(once & (F.schema_of_variant(variant) == "BIGINT") & value.between(low, high), value)


def literal_pattern(text: str) -> str:
    r"""``text`` for LIKE with \ % _ taken literally."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def nonempty(c: Column | str) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def wildcard_regex(pattern: Column) -> Column:
    """Regular expression of a * and ? pattern; matches are case-insensitive."""
    escaped = F.regexp_replace(pattern, r"([.\\+^$()\[\]{}|])", r"\\$1")
    return F.concat(F.lit("(?is)^"), F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
