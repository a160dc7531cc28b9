"""Typed reads from JSON held as VARIANT.

A field that is absent, or holds another JSON type than the one asked for,
reads as the type's default ('' or 0), never as NULL and never as JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: str | Column) -> Column:
    """Text to VARIANT, NULL when it is not JSON."""
    return F.try_parse_json(text)


def json_array(doc: str | Column, path: str = "$") -> Column:
    """Elements at `path` as array<variant>; NULL when there is no array."""
    return F.try_variant_get(doc, path, "array<variant>")


def _kind(doc: str | Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(doc, path, "variant"))


def json_str(doc: str | Column, path: str = "$", blank_as_null: bool = False) -> Column:
    """The string at `path`, else ''.

    `blank_as_null=True` gives NULL instead of '', so that a `coalesce` over
    several paths falls through.
    """
    text = F.when(_kind(doc, path) == "STRING", F.try_variant_get(doc, path, "string"))
    if blank_as_null:
        return F.nullif(text, F.lit(""))
    return F.coalesce(text, F.lit(""))


def json_int(doc: str | Column, path: str = "$") -> Column:
    """The whole number at `path`, else 0."""
    number = F.when(_kind(doc, path) == "BIGINT", F.try_variant_get(doc, path, "bigint"))
    return F.coalesce(number, F.lit(0).cast("bigint"))


def json_float(doc: str | Column, path: str = "$") -> Column:
    """The number at `path`, else 0.0."""
    kind = _kind(doc, path)
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.coalesce(F.when(numeric, F.try_variant_get(doc, path, "double")), F.lit(0.0))
