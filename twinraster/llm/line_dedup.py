"""Line deduplication with DataFrame functions only.

Lines are exploded with their position, normalised and hashed; the documents of every hash are counted before anything else
moves; positions to drop travel back to the document, which is reassembled from the lines that stay.
"""
from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

BLANKS = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    """The line without ASCII blanks at either end and with A-Z lower-cased; other letters stay as they are."""
    return F.translate(F.trim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def repeated_lines(lines: DataFrame, min_docs: int = 2) -> DataFrame:
    """(h, first): hashes held by at least ``min_docs`` documents and the smallest document of each.

    ``lines`` has ``h`` and ``id``. Both aggregates combine before the shuffle, so a line that a third of all documents
    hold costs one row per task. Lines of documents without an id are not counted.
    """
    grouped = lines.filter(F.col("id").isNotNull()).groupBy("h")
    if min_docs <= 2:  # two documents differ exactly when the smallest and the largest id do
        found = grouped.agg(F.min("id").alias("first"), F.max("id").alias("last")).filter(
            F.col("first") != F.col("last") if min_docs == 2 else F.lit(True))
    else:
        found = grouped.agg(F.min("id").alias("first"), F.count_distinct("id").alias("n")).filter(F.col("n") >= min_docs)
    return found.select("h", "first")


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2,
    counts: tuple[str, str] = ("n_lines", "n_dropped"),
) -> DataFrame:
    """``docs`` with the text reassembled from the lines that stay, plus the two ``counts`` columns.

    A key of at least ``min_chars`` code points found in at least ``min_docs`` documents loses all its lines except those of
    the smallest id. Defined cases: a null or empty text is one empty line and stays as it is; a row with a null id is not
    counted and keeps all lines; rows that repeat an id are one document; if every line goes, the text is empty; a column
    of ``docs`` named like one of ``counts`` is replaced; all other columns pass unchanged. The rows out are the rows in.
    """
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.xxhash64(F.col(text_col)).alias("version"),
    )
    keyed = (
        marked.select("id", "version", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .select("id", "version", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.char_length("key") >= min_chars)
        .select("id", "version", "pos", F.unhex(F.md5("key")).alias("h"))
    )
    repeated = cut(repeated_lines(keyed, min_docs))
    dropped = (
        keyed.join(repeated, "h").filter(F.col("id") != F.col("first"))
        .groupBy("id", "version").agg(F.collect_set("pos").alias("gone"))
    )
    lines, last = _lines(F.col("text")), F.size(_lines(F.col("text"))) - 1
    kept = F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), last), F.col("gone")), lambda i: F.element_at(lines, i + 1)), "\n")
    done = marked.join(dropped.hint("shuffle_hash"), ["id", "version"], "left").select(
        "row",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept"),
        (last + 1).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
    return done.select(
        *[(F.col("kept") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns if c not in counts],
        F.col("n_lines").alias(counts[0]), F.col("n_dropped").alias(counts[1]),
    )
