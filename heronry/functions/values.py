"""Scalar rules: name-based identifiers, instants, guards on JSON values, characters of nested texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the name space of addresses in RFC 9562.
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, space: str = URL_SPACE) -> Column:
    """Version 5 identifier of a name: the SHA-1 of name space and name, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), name.cast("binary")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def instant(text: Column) -> Column:
    """ISO-8601 with a zone (Z or an offset) -> timestamp; null without one, or if it is none."""
    zoned = text.rlike("^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}(:\\d{2}(\\.\\d{1,6})?)?(Z|[+-]\\d{2}:\\d{2})$")
    whole = F.regexp_replace(text, "^(.{10}[T ]\\d{2}:\\d{2})(?=Z|[+-])", "$1:00")
    return F.when(zoned, whole.try_cast("timestamp"))


def isoformat(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX")


def string_leaves(document: Column) -> Column:
    """Characters of all strings in a JSON document that aren't keys; an escape is one."""
    found = F.regexp_extract_all(document, F.lit('"(?:[^"\\\\]|\\\\.)*+"\\s*:|"((?:[^"\\\\]|\\\\.)*+)"'), 1)
    pair, code, other = "\\\\u[dD][89abAB][0-9a-fA-F]{2}\\\\u[dD][c-fC-F][0-9a-fA-F]{2}", "\\\\u[0-9a-fA-F]{4}", "\\\\."
    size = lambda s: F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, pair, "x"), code, "x"), other, "x"))
    return F.coalesce(F.aggregate(F.transform(found, size), F.lit(0), lambda a, n: a + n), F.lit(0)).cast("long")


def json_type(document: Column, path: str) -> Column:
    """Type of a member of a JSON document: BIGINT, BOOLEAN, STRING, ...; null without the member."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(document), path, "variant"))


def whole_number(document: Column, path: str) -> Column:
    """A member as a long if it is a whole number; true and false aren't numbers."""
    return F.when(json_type(document, path) == "BIGINT", F.try_variant_get(F.try_parse_json(document), path, "bigint"))


def finite(x: Column) -> Column:
    """x if it is a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)
