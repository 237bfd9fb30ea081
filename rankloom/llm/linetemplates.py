"""Line deduplication by a log-template tree of fixed depth.

A line falls through the tree by its number of tokens and its leading tokens, where a token
with a digit is a variable field. In a leaf, a token that few lines share at its place is a
variable field too; what remains is the line's template. Templates that recur in at least
``least`` different texts are dropped from all documents. With ``identical``, lines that stand
unchanged in two different texts or more are dropped as well, whatever their tokens are.

One pass over the texts names every line by hashes of its leaf and of its tokens; identical
lines and leaves that recur are found from that small table. Only lines of such leaves are
taken further, and the texts themselves move once, to meet the places of their dropped lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import run_folder, stored, whole_text

LEAST = 5
DEPTH = 3
# A template has to be constant in at least this share of its tokens.
CONSTANT = 0.5
FIELD = "<*>"


def _masked(tokens):
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), FIELD).otherwise(t))


def _tokens(line: str):
    # Plain searches: most lines hold neither of the two, and a blank needs no pattern.
    blank = F.replace(F.replace(F.col(line), F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    return F.array_remove(F.split(blank, " ", -1), "")


def _name(column, first: str, second: str) -> list:
    """128 bits of a text, as two numbers."""
    return [F.xxhash64(column).alias(first), F.xxhash64(F.lit(1), column).alias(second)]


BODY = ["body", "body2"]
LINE = ["line", "line2"]


def _lines(docs: DataFrame, text_col: str) -> DataFrame:
    """Every line that has tokens: body, body2 (the name of its text), place, tokens."""
    text = whole_text(text_col)
    rows = docs.select(*_name(text, *BODY), F.posexplode(F.split(text, "\n", -1)).alias("place", "line"))
    return rows.select(*BODY, "place", _tokens("line").alias("tokens")).where(F.size("tokens") > 0)


def _leaf(depth: int):
    leading = F.array_join(_masked(F.slice("tokens", 1, depth)), " ")
    return F.concat_ws(" ", F.size("tokens").cast("string"), leading)


def parsed(docs: DataFrame, depth: int, text_col: str, folder: str) -> DataFrame:
    """body, body2, place, key (a hash of the leaf), same, same2 (the name of its tokens) of every line, stored."""
    line = F.array_join("tokens", " ")
    return stored(_lines(docs, text_col).select(
        *BODY, "place", F.xxhash64(_leaf(depth)).alias("key"), *_name(line, "same", "same2")), f"{folder}/parsed")


def line_templates(
    docs: DataFrame, least: int = LEAST, depth: int = DEPTH, constant: float = CONSTANT, text_col: str = "text",
    lines: DataFrame | None = None,
) -> DataFrame:
    """The lines whose template recurs: body, body2, place, template, n_texts. ``lines`` are those of ``parsed``."""
    folder = run_folder(docs.sparkSession, "lines")
    lines = parsed(docs, depth, text_col, folder) if lines is None else lines
    # Leaves by hash: one that shares its hash with another is only looked at in vain.
    leaves = lines.select("key", *BODY).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    leaves = stored(leaves.where(F.col("n") >= least).select("key"), f"{folder}/leaves")
    own = _lines(docs, text_col).withColumn("key", F.xxhash64(_leaf(depth))).join(leaves, "key", "left_semi")
    own = own.select(*BODY, "place", F.array_join(_masked(F.col("tokens")), " ").alias("masked")).distinct()
    own = stored(own, f"{folder}/recurring")

    # A line counts once for each text, so a masked line is first one row for each text that has it.
    kinds = own.select("masked", *BODY).distinct().groupBy("masked").agg(F.count(F.lit(1)).alias("n"))
    kinds = stored(kinds.select("masked", *_name(F.col("masked"), *LINE), "n"), f"{folder}/kinds")
    constants = _constants(kinds, least, depth)
    tokens = F.split("masked", " ")
    parts = F.transform(tokens, lambda t, at: F.when((at < depth) | F.array_contains("constants", at), t).otherwise(FIELD))
    template = kinds.join(constants.hint("merge"), LINE, "left").select("masked", parts.alias("parts"))
    fixed = F.size(F.filter("parts", lambda t: t != FIELD)) / F.size("parts")
    template = template.where(fixed >= constant).select("masked", F.array_join("parts", " ").alias("template"))
    template = stored(template, f"{folder}/templates")

    # A template tells its leaf: the number of its tokens and the leading ones.
    named = own.join(template.hint("merge"), "masked").drop("masked")
    counts = named.select("template", *BODY).distinct().groupBy("template").agg(F.count(F.lit(1)).alias("n_texts"))
    recurring = counts.where(F.col("n_texts") >= least)
    return named.join(recurring.hint("merge"), "template").select(*BODY, "place", "template", "n_texts")


def _constants(kinds: DataFrame, least: int, depth: int) -> DataFrame:
    """line, line2 and the places (constants) beyond the leading tokens whose token enough lines of the leaf share.

    ``kinds``: masked, line, line2 (its name), n. A row for every token moves, so leaves, lines and
    tokens are names of fixed size. Leading tokens are those of the whole leaf and need no count.
    """
    tokens = F.split("masked", " ")
    leaf = F.concat_ws(" ", F.size(tokens).cast("string"), F.array_join(F.slice(tokens, 1, depth), " "))
    spread = kinds.select(*LINE, "n", *_name(leaf, "leaf", "leaf2"), F.posexplode(tokens).alias("at", "token"))
    spot = ["leaf", "leaf2", "at", "token"]
    spread = spread.where((F.col("at") >= depth) & (F.col("token") != FIELD)).select(
        *LINE, "n", "at", F.xxhash64(*spot).alias("spot"), F.xxhash64(F.lit(1), *spot).alias("spot2"))
    shared = spread.groupBy("spot", "spot2").agg(F.sum("n").alias("held")).where(F.col("held") >= least)
    # Both sides grow with the lines, so they are merged at any size.
    met = spread.join(shared.select("spot", "spot2").hint("merge"), ["spot", "spot2"], "left_semi")
    return met.groupBy(*LINE).agg(F.collect_list("at").alias("constants"))


def identical_lines(lines: DataFrame, folder: str) -> DataFrame:
    """The lines whose tokens stand in at least two different texts: body, body2, place."""
    # Two texts are enough, so the outermost numbers of their names tell without a list of them.
    met = lines.groupBy("same", "same2").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in BODY for f in (F.min, F.max)))
    again = met.where("min_body <> max_body OR min_body2 <> max_body2").select("same", "same2")
    again = stored(again, f"{folder}/identical")
    # Both sides grow with the lines, so they are merged at any size.
    return lines.join(again.hint("merge"), ["same", "same2"], "left_semi").select(*BODY, "place")


def drop_lines(
    docs: DataFrame, least: int = LEAST, depth: int = DEPTH, constant: float = CONSTANT,
    id_col: str = "doc_id", text_col: str = "text", identical: bool = False,
) -> DataFrame:
    """Texts without the lines whose template recurs: doc_id, n_lines, n_dropped, kept_text.

    Lines end with a line feed; tokens are runs of anything but spaces, tabs and carriage
    returns; lines without tokens stay. Equal texts count once towards ``least``. With
    ``identical``, lines with the same tokens in two different texts go as well, whatever
    their number; white space between tokens makes no difference. A null text is
    one empty line; a null id stays null; rows that repeat are all returned; no rows give
    no rows; other columns are not read.
    """
    folder = run_folder(docs.sparkSession, "lines")
    lines = parsed(docs, depth, text_col, folder)
    found = line_templates(docs, least, depth, constant, text_col, lines).select(*BODY, "place")
    if identical:
        found = found.unionByName(identical_lines(lines, folder))
    # Rows with the same text lose the same lines, so the text alone names them.
    dropped = stored(found.groupBy(*BODY).agg(F.collect_set("place").alias("places")), f"{folder}/dropped")
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *_name(text, *BODY))
    split = F.split("text", "\n", -1)
    kept = F.filter(split, lambda _, i: ~F.array_contains("places", i))
    # Both sides grow with the documents, so they are merged at any size.
    joined = rows.join(dropped.hint("merge"), BODY, "left")
    return joined.select(
        "doc_id", F.size(split).cast("long").alias("n_lines"),
        F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long").alias("n_dropped"),
        F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"))
