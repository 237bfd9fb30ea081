"""Binding a column of JSON filters to a corpus.

Up to ``MAX_COMPILED`` distinct filters become JVM predicates evaluated once per
document into a bit set. More than that, or keys no variant path can spell, are
checked as data on the (query, document) candidates; both are exact.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.metadata import compilable, contains

MAX_COMPILED = 62


def distinct_filters(queries: DataFrame) -> list[str]:
    """The filters in use, or ``MAX_COMPILED + 1`` of them when there are more."""
    distinct = queries.where("filter IS NOT NULL").select("filter").distinct()
    return sorted(r[0] for r in distinct.limit(MAX_COMPILED + 1).collect())


def promoted(corpus: DataFrame) -> dict[str, str]:
    """The columns of a corpus that hold a metadata path, by path."""
    return {f.metadata["path"]: f.name for f in corpus.schema.fields if "path" in f.metadata}


def _equalities(wanted, path: str = "$") -> dict[str, str]:
    """The strings that a filter asks for, by path; arrays and other values are left to the whole test."""
    if isinstance(wanted, str):
        return {path: wanted}
    if isinstance(wanted, dict):
        return {p: v for key, inner in wanted.items() for p, v in _equalities(inner, f"{path}.{key}").items()}
    return {}


def _stated(corpus: DataFrame, wanted) -> F.Column | None:
    """What promoted columns say about a filter: necessary, not sufficient."""
    columns = promoted(corpus)
    tests = [F.col(columns[p]) == F.lit(v) for p, v in _equalities(wanted).items() if p in columns]
    return reduce(lambda a, b: a & b, tests) if tests else None


def bind_filters(
    corpus: DataFrame, queries: DataFrame, texts: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Returns the corpus and queries with matching filter columns, or with none.

    ``texts`` are the distinct filters. Compiled: ``filter_bits`` / ``filter_bit``
    (-1 for no filter). As data: ``metadata`` / ``filter``. No filters at all:
    neither side has a column.

    Where the corpus has a promoted column for a path that a filter asks a string of, the
    filter is tested by that column first. If every query has a filter with such a test, rows
    that fail them all are not read: the tests are stated in the scan.
    """
    if not texts:
        return corpus, queries.drop("filter")
    try:
        parsed = [json.loads(t) for t in texts]
    except ValueError as bad:
        raise ValueError("metadata filters must be JSON") from bad
    if len(texts) > MAX_COMPILED or not all(compilable(p) for p in parsed):
        return corpus, queries
    stated = [_stated(corpus, wanted) for wanted in parsed]
    if all(s is not None for s in stated) and queries.where("filter IS NULL").isEmpty():
        corpus = corpus.where(reduce(lambda a, b: a | b, stated))
    variant = F.try_parse_json("metadata")
    bits, bit = F.lit(0).cast("long"), F.lit(-1)
    for i, (text, wanted) in enumerate(zip(texts, parsed)):
        held = contains(variant, wanted)
        held = held if stated[i] is None else F.coalesce(stated[i], F.lit(False)) & held
        flag = F.when(held, F.lit(1 << i)).otherwise(F.lit(0))
        bits = bits + flag.cast("long")
        bit = F.when(F.col("filter") == F.lit(text), F.lit(i)).otherwise(bit)
    return (
        corpus.withColumn("filter_bits", bits),
        queries.withColumn("filter_bit", bit.cast("long")).drop("filter"),
    )
