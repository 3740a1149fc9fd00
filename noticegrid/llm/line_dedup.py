"""Line dedup by a log-template tree of fixed depth.

A line goes to a leaf by its number of tokens and its leading tokens, with tokens that hold a digit read as a variable field.
In a leaf, a token that enough documents have at a place is constant there; anything else at that place is a variable
field too. The line with its fields blanked is its template. A template with enough constant tokens that stands in
more documents than the limit is recurring, and its lines are dropped from every document.

Documents with the same text count once: a page copied whole is for near-duplicate removal, not boilerplate. So do the
near copies of a text, where their classes are given; without them each changed copy is a document of its own. The
limit is a number of documents, whatever the size of the table.

Only DataFrame functions. Lines in rare leaves go no further than the first count. Leaves, constant tokens and templates are looked up
by hashes, in tables of fixed width: sent to all tasks up to BROADCAST_ROWS rows, shuffled beyond. A line's constant tokens are
counted, and joined into one number for its template, before anything is shuffled.

Null and empty texts have no lines and stay as they are. Lines without a token stay. Repeated rows lose the same lines, ties cannot arise.
Very long texts and lines are read whole. An empty table gives no rows. Further columns are kept as they are, whatever their names,
but for n_chars, which is set anew where it is there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticegrid.llm.base import SPACE, fresh, stage

DEPTH = 3
LIMIT_DOCUMENTS = 10
LEAST_CONSTANT_PERCENT = 50
FIELD = "<*>"
BLANKS = " \t\n\x0b\x0c\r"
BROADCAST_ROWS = 100_000


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t))


def leaf_of(tokens: Column) -> Column:
    return F.xxhash64(F.size(tokens), F.concat_ws("\n", masked(F.slice(tokens, 1, DEPTH))))


def parsed(texts: DataFrame) -> DataFrame:
    """The keys, place, leaf and tokens of every line that has a token (texts: keys, text)."""
    keys = [c for c in texts.columns if c != "text"]
    lines = texts.select(*keys, F.posexplode(lines_of(F.col("text"))).alias("place", "line"))
    return lines.select(*keys, "place", F.btrim("line", F.lit(BLANKS)).alias("line")).filter("line <> ''") \
        .select(*keys, "place", F.split("line", SPACE).alias("tokens")).withColumn("leaf", leaf_of(F.col("tokens")))


def held_by(rows: DataFrame, *what: str) -> DataFrame:
    """In how many documents each thing stands; counted before and after the shuffle."""
    return rows.groupBy(*what, "key").agg(F.lit(1).alias("one")).groupBy(*what).agg(F.count(F.lit(1)).alias("n_docs"))


def looked_up(table: DataFrame, name: str) -> DataFrame:
    """The table (of numbers only) written, and marked to be sent to all tasks if it has no more rows than BROADCAST_ROWS; else it is shuffled."""
    written = stage(table, name)
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def classed(copies: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What puts the class of a text into `key` of rows with its `id`; a text without a class is one of its own.

    Beyond BROADCAST_ROWS the rows are shuffled by text, after equal ones are one, so that a text with many copies is no hot key.
    """
    table = stage(copies, "line-copies")
    few = table.count() <= BROADCAST_ROWS

    def with_class(rows: DataFrame) -> DataFrame:
        rows = rows.join(F.broadcast(table), "id", "left") if few else rows.distinct().join(table, "id", "left")
        return rows.withColumn("key", F.coalesce("class", "id"))
    return with_class


def dropped_lines(docs: DataFrame, limit_documents: int = LIMIT_DOCUMENTS, least_constant_percent: int = LEAST_CONSTANT_PERCENT,
                  copies: DataFrame | None = None) -> tuple[DataFrame, Column]:
    """(key, places): the lines to drop from the text with that key; and the key of a text.

    copies (id, class): the texts, by their xxhash64, that count as one.
    """
    key = F.md5(F.col("text"))
    by = "key" if copies is None else "id"
    with_class = (lambda rows: rows) if copies is None else classed(copies)
    held = lambda rows, *what: held_by(with_class(rows), *what).filter(F.col("n_docs") > limit_documents).drop("n_docs")
    texts = docs.filter(F.length("text") > 0).select(key.alias("key"), *([] if copies is None else [F.xxhash64("text").alias("id")]), "text")
    narrow = parsed(docs.filter(F.length("text") > 0).select(F.xxhash64("text").alias(by), "text"))
    leaves = held(narrow.select("leaf", by), "leaf")
    lines = parsed(texts).join(looked_up(leaves, "line-leaves"), "leaf").withColumn("tokens", masked(F.col("tokens")))
    # Texts with one key have the same lines; each is read by itself.
    lines = stage(lines.withColumn("line", F.monotonically_increasing_id()), "line-parsed")
    own = ["line", "key", *({by} - {"key"}), "place", "leaf"]
    words = lines.select(*own, F.size("tokens").alias("n"), F.posexplode("tokens").alias("at", "token")).filter(F.col("token") != FIELD) \
        .select(*own, "n", F.xxhash64("at", "token").alias("token"))
    constant = looked_up(held(words.select("leaf", "token", by), "leaf", "token"), "line-constant")
    blanked = words.join(constant, ["leaf", "token"]).groupBy(*own, "n") \
        .agg(F.count(F.lit(1)).alias("n_constant"), F.bit_xor("token").alias("template")) \
        .filter(100 * F.col("n_constant") >= least_constant_percent * F.col("n")).select(*own[1:], "template")
    blanked = stage(blanked, "line-templates")
    recurring = held(blanked.select("leaf", "template", by), "leaf", "template")
    gone = blanked.join(looked_up(recurring, "line-recurring"), ["leaf", "template"])
    # Written, so that a text with many copies is a side of the last join that Spark can split.
    return stage(gone.groupBy("key").agg(F.collect_set("place").alias("places")), "line-dropped"), key


def without_lines(docs: DataFrame, n_lines: str = "n_lines", n_dropped: str = "n_dropped", **options) -> DataFrame:
    """The documents with their recurring lines dropped, and two columns more: lines of the text before, and lines dropped."""
    found, key = dropped_lines(docs, **options)
    own, places = fresh(docs, "_key"), fresh(docs, "_places")
    joined = docs.withColumn(own, key).join(found.toDF(own, places), own, "left")
    left = F.array_join(F.filter(lines_of(F.col("text")), lambda line, i: ~F.array_contains(places, i)), "\n")
    out = joined.withColumn(n_lines, F.when(F.length("text") > 0, F.size(lines_of(F.col("text")))).otherwise(0).cast("long")) \
        .withColumn(n_dropped, F.when(F.col(places).isNull(), 0).otherwise(F.size(places)).cast("long")) \
        .withColumn("text", F.when(F.col(places).isNull(), F.col("text")).otherwise(left))
    if "n_chars" in docs.columns:
        now = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(n_dropped) > 0, now).otherwise(F.col("n_chars")))
    return out.select(*docs.columns, n_lines, n_dropped)
