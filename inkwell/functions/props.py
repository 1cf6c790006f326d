"""Getters for members of JSON text: a member that is missing or of another type gives the default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INT32 = 2**31


def _member(json: Column, name: str) -> Column:
    """The member's JSON text with quotes, so that "1" and 1 differ."""
    variant = F.try_parse_json(json)
    return F.to_json(F.try_variant_get(variant, f"$['{name}']", "variant"))


def get_string(json: Column, name: str, default: str = "") -> Column:
    raw = _member(json, name)
    return F.coalesce(F.when(raw.startswith('"'), F.get_json_object(json, f"$['{name}']")), F.lit(default))


def get_int(json: Column, name: str, default: int = 0) -> Column:
    """Whole numbers that fit in a long; numbers with a fraction and larger ones give the default."""
    raw = _member(json, name)
    return F.coalesce(F.when(raw.rlike(r"^-?\d+$"), raw.try_cast("long")), F.lit(default).cast("long"))


def get_bool(json: Column, name: str, default: bool = False) -> Column:
    raw = _member(json, name)
    return F.coalesce(F.when(raw.isin("true", "false"), raw == "true"), F.lit(default))


def get_strings(json: Column, name: str) -> Column:
    """The strings of an array member; items of other types are skipped."""
    items = F.try_variant_get(F.try_parse_json(json), f"$['{name}']", "array<variant>")
    texts = F.transform(items, lambda x: F.to_json(x))
    kept = F.filter(texts, lambda t: t.startswith('"'))
    return F.coalesce(F.transform(kept, lambda t: F.from_json(F.concat(F.lit('{"x":'), t, F.lit("}")), "x string")["x"]), F.array().cast("array<string>"))


def get_numbers(json: Column, name: str) -> Column:
    """The whole numbers of an array member."""
    items = F.try_variant_get(F.try_parse_json(json), f"$['{name}']", "array<variant>")
    texts = F.transform(items, lambda x: F.to_json(x))
    return F.coalesce(F.transform(F.filter(texts, lambda t: t.rlike(r"^-?\d+$")), lambda t: t.try_cast("long")), F.array().cast("array<bigint>"))
