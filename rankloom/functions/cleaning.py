"""Validation and clean-up of untrusted request fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.schema import MAX_IMAGE_CHARS, REGIONS

_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def tenant_key(user_id: Column, database: Column) -> Column:
    return F.concat_ws("-", user_id.cast("string"), database)


def key_hash(api_key: Column) -> Column:
    """SHA-256 hex, the only form in which keys are stored."""
    return F.sha2(api_key, 256)


def strict_int(text: Column) -> Column:
    """A 32-bit integer with optional sign; NULL for anything else, blanks included."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))


def rfc3339(text: Column) -> Column:
    """UTC wall-clock time of an RFC 3339 string; NULL when malformed (UTC session)."""
    return F.when(text.rlike(_RFC3339), F.try_to_timestamp(F.upper(text))).cast("timestamp_ntz")


def first_of(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def any_empty(*columns: Column) -> Column:
    """Whether a required field is the empty string; NULL fields are allowed."""
    tests = [F.coalesce(c == "", F.lit(False)) for c in columns]
    return reduce(lambda a, b: a | b, tests)


def decode_base64(text: Column) -> Column:
    """Bytes of strict base64 text, NULL when it is not.

    Strict means whole groups of four, no line breaks, and no stray bits in
    front of the padding.
    """
    strict = text.rlike(r"\A[A-Za-z0-9+/]*([AQgw]==|[AEIMQUYcgkosw048]=)?\z") & (F.length(text) % 4 == 0)
    return F.when(strict, F.try_to_binary(text, F.lit("base64")))


def image_fits(encoded: Column, most: int = MAX_IMAGE_CHARS) -> Column:
    return F.octet_length(encoded) <= most


def known_region(region: Column) -> Column:
    return F.coalesce(region.isin(*REGIONS), F.lit(False))
