"""Small tables with the odd rows that every operator has to take."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, key int"


def odd_documents(spark, extra=()):
    """Null and empty texts, a null id and source, repeated rows, one very long text, clashing columns."""
    long_text = " ".join(f"word{i % 97} Other{i % 13}" for i in range(20_000))
    rows = [
        (1, "Hello World, again and again", "en", "a", 28, "x", 1),
        (2, "hello world, AGAIN and again", "en", "a", 28, "x", 1),
        (3, None, "en", None, None, None, None),
        (4, "", None, "b", 0, None, 2),
        (5, "  \t\n ", "en", "b", 5, "y", 2),
        (6, "Ärger und Öl", "de", "b", 12, "y", 3),
        (7, "ärger und öl", "de", "b", 12, "y", 3),
        (8, long_text, "en", "a", len(long_text), "z", 4),
        (9, "naïve 🙂 text\nwith lines\nand naïve 🙂 text", "fr", "c", 40, "z", 4),
        (9, "naïve 🙂 text\nwith lines\nand naïve 🙂 text", "fr", "c", 40, "z", 4),
        (None, "no id here", "en", "c", 10, "q", 5),
        *extra,
    ]
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
