"""JSON metadata: normalising, and the containment predicate behind filters."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMERIC = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"
_PLAIN_KEY = re.compile(r"^[^\"\\\[\]']+$")


def normalize(metadata: Column) -> Column:
    """Keep JSON objects; NULL, arrays, scalars and bad JSON become ``{}``."""
    parsed = F.try_parse_json(metadata)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    return F.when(F.coalesce(is_object, F.lit(False)), metadata).otherwise(F.lit("{}"))


def active_filter(text: Column) -> Column:
    """A filter that is absent or JSON null means "no filter"."""
    return F.when(F.trim(text) == "null", F.lit(None).cast("string")).otherwise(text)


def compilable(wanted) -> bool:
    """Whether every key of a parsed filter can be written as a variant path."""
    if isinstance(wanted, dict):
        return all(_PLAIN_KEY.match(k) and compilable(v) for k, v in wanted.items())
    if isinstance(wanted, list):
        return all(compilable(v) for v in wanted)
    return True


def contains(doc: Column, wanted) -> Column:
    """Predicate: the variant ``doc`` contains the parsed JSON value ``wanted``.

    Objects match recursively, every array element of the filter must be
    contained in some array element of the document, numbers match by value and
    never match strings.
    """
    if not isinstance(wanted, dict):
        return F.lit(False)
    return F.coalesce(_contained(doc, "$", wanted), F.lit(False))


def _contained(doc: Column, path: str, wanted) -> Column:
    value = F.try_variant_get(doc, path, "variant")
    kind = F.schema_of_variant(value)
    if isinstance(wanted, dict):
        test = kind.startswith("OBJECT")
        for key, inner in wanted.items():
            test = test & _contained(doc, f'{path}["{key}"]', inner)
        return test
    if isinstance(wanted, list):
        elements = F.try_variant_get(doc, path, "array<variant>")
        test = kind.startswith("ARRAY")
        for inner in wanted:
            test = test & F.exists(elements, _element_test(inner))
        return test
    if wanted is None:
        return kind == "VOID"
    if isinstance(wanted, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(doc, path, "boolean") == F.lit(wanted))
    if isinstance(wanted, str):
        return (kind == "STRING") & (F.try_variant_get(doc, path, "string") == F.lit(wanted))
    if isinstance(wanted, int) and abs(wanted) < 2**63:
        exact = F.try_variant_get(doc, path, "bigint") == F.lit(wanted)
        as_double = F.try_variant_get(doc, path, "double") == F.lit(float(wanted))
        return F.when(kind.rlike("INT$"), exact).when(kind.rlike(_NUMERIC), as_double)
    return kind.rlike(_NUMERIC) & (F.try_variant_get(doc, path, "double") == F.lit(float(wanted)))


def _element_test(wanted):
    return lambda x: F.coalesce(_contained(x, "$", wanted), F.lit(False))


def json_contains(doc, wanted) -> bool:
    """The same rule on parsed values, for filters that only exist as data."""
    if isinstance(wanted, dict):
        return isinstance(doc, dict) and all(
            k in doc and json_contains(doc[k], v) for k, v in wanted.items()
        )
    if isinstance(wanted, list):
        return isinstance(doc, list) and all(
            any(json_contains(d, w) for d in doc) for w in wanted
        )
    if isinstance(wanted, bool) or isinstance(doc, bool):
        return isinstance(wanted, bool) and isinstance(doc, bool) and doc == wanted
    if isinstance(wanted, (int, float)):
        return isinstance(doc, (int, float)) and doc == wanted
    return type(doc) is type(wanted) and doc == wanted


class ContainmentCheck:
    """Memoized text-level containment for tasks that see filters as data."""

    def __init__(self) -> None:
        self._parsed: dict = {}
        self._seen: dict = {}

    def _parse(self, text):
        if text not in self._parsed:
            try:
                self._parsed[text] = (json.loads(text),)
            except (TypeError, ValueError):
                self._parsed[text] = None
        return self._parsed[text]

    def __call__(self, metadata, wanted) -> bool:
        key = (metadata, wanted)
        if key not in self._seen:
            doc, want = self._parse(metadata), self._parse(wanted)
            self._seen[key] = bool(
                doc and want and isinstance(want[0], dict) and json_contains(doc[0], want[0])
            )
            if len(self._seen) > 500_000:
                result = self._seen[key]
                self._seen.clear()
                self._parsed.clear()
                return result
        return self._seen[key]
