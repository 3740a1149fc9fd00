"""Quality rules: counts per document, and lines that too many documents of one host share.

Lines are normalised (lower case, one blank between words) and hashed; a line's documents are counted once each per host,
lines above the limit are taken away, and documents that keep too few of their words are rejected.

Only DataFrame functions. A document costs one pass; of its lines only hashes and word counts are shuffled. Counts combine before
the shuffle, so a line that a third of all documents share is one row per task. `source` is the host.

Null and empty texts: all counts 0, base_failed. A null host is a host of its own. Repeated rows are judged
each, and count as documents of their own. Very long texts are read whole. An empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticegrid.llm.base import SPACE, stage, words_of

MIN_WORDS = 50
MOST_REPEATED_PERCENT = 50
# A line is above the limit in more documents of a host than this, however large the host.
LIMIT_DOCUMENTS = 5
LEAST_KEPT_PERCENT = 50


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def repeated_words(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words from `words`: those inside a window of three words that the text holds twice or more.

    A window is one number, its hash above its place; in the sorted numbers equal windows are neighbours, and
    neighbours with the same hash are compared word by word.
    """
    n = F.size("words")
    word = lambda i: F.get("words", i)
    number = lambda i: F.call_function(
        "shiftleft", F.xxhash64(word(i), word(i + 1), word(i + 2)), F.length(F.bin(n))).bitwiseOR(i.cast("long"))
    place = lambda x: x.bitwiseAND(F.col("_low")).cast("int")
    same = lambda i, j: (word(i) == word(j)) & (word(i + 1) == word(j + 1)) & (word(i + 2) == word(j + 2))

    def twins(k: Column) -> Column:
        x, y = F.get("_sorted", k), F.get("_sorted", k - 1)
        return (x.bitwiseXOR(y) <= F.col("_low")) & (x.bitwiseXOR(y) >= 0) & same(place(x), place(y))

    pairs = F.when(n >= 4, F.filter(F.sequence(F.lit(1), n - 3), twins)).otherwise(F.array().cast("array<int>"))
    starts = F.sort_array(F.array_distinct(F.concat(
        F.transform("_pairs", lambda k: place(F.get("_sorted", k))),
        F.transform("_pairs", lambda k: place(F.get("_sorted", k - 1))))))
    reach = lambda k: F.least(F.get("_starts", k) - F.get("_starts", k - 1), F.lit(3))
    covered = F.aggregate(F.sequence(F.lit(1), F.size("_starts") - 1), F.lit(3), lambda total, k: total + reach(k))
    return docs.withColumn("_low", F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n))) - 1) \
        .withColumn("_sorted", F.when(n >= 4, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), number)))
                    .otherwise(F.array().cast("array<bigint>"))) \
        .withColumn("_pairs", pairs).withColumn("_starts", starts) \
        .withColumn("n_repeat_words", F.when(F.size("_starts") > 1, covered).otherwise(0).cast("long")) \
        .drop("_low", "_sorted", "_pairs", "_starts")


def measured(docs: DataFrame) -> DataFrame:
    """One row per document: its counts, and the hash and number of words of each line that has a word. Written once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select("doc_id", F.col("source").alias("host"), text.alias("text"), words_of(text).alias("words"),
                        lines_with_words(text).alias("lines"))
    normal = lambda x: F.lower(F.regexp_replace(F.trim(F.regexp_replace(x, SPACE, " ")), " +", " "))
    n_of = lambda x: F.size(F.filter(F.split(x, SPACE), lambda w: w != ""))
    base = repeated_words(lines).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "host", F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        F.transform("lines", lambda x: F.struct(F.xxhash64(normal(x)).alias("line"), n_of(x).alias("n"))).alias("lines"))
    return stage(base, "quality-measured")


def shared_lines(measured_docs: DataFrame, limit_documents: int) -> DataFrame:
    """(host, line) of the lines in more documents of their host than the limit allows."""
    return measured_docs.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line")) \
        .groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") > limit_documents).select("host", "line")


def judge(docs: DataFrame, limit_documents: int = LIMIT_DOCUMENTS, least_kept_percent: int = LEAST_KEPT_PERCENT) -> DataFrame:
    """doc_id, the counts, base_failed, the words in lines above the limit (shared_words), and kept."""
    table = measured(docs)
    shared = shared_lines(table, limit_documents)
    lines = table.select("row", F.col("host").alias("own_host"), F.inline("lines"))
    lost = lines.join(shared, F.col("own_host").eqNullSafe(shared["host"]) & (lines["line"] == shared["line"])) \
        .groupBy("row").agg(F.sum("n").alias("shared_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("shared_words")
    return table.drop("lines").join(lost, "row", "left").withColumn("shared_words", F.coalesce("shared_words", F.lit(0)).cast("long")) \
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "shared_words",
                failed.alias("base_failed"), (~failed & (100 * left >= least_kept_percent * F.col("n_words"))).alias("kept"))
