"""Lines that many documents share: counted by hash, dropped, and the rest put together again by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aircapture.llm.common import SPACES, cut

MIN_CHARS = 40
MIN_DOCS = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    """The lines of a text; null and the empty text are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACES)), _UPPER, _LOWER)


def _long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text_hash, position, hash): the lines whose key has ``min_chars`` code points or more.

    A hash has 128 bits: of 10^13 different lines, two get the same one with a
    probability under 10^-12.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(split_lines(F.col("text"))).alias("position", "line"))
    # the key of a line is never longer than the line
    keyed = rows.where(F.length("line") >= min_chars).withColumn("key", line_key(F.col("line")))
    keyed = keyed.where(F.length("key") >= min_chars)
    return keyed.select("doc_id", "text_hash", "position", F.unhex(F.md5("key")).alias("hash"))


def common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(hash, n_docs, last_doc): the long lines of ``min_docs`` documents or more, and the largest doc_id that has each.

    Pairs of hash and document are made distinct first, in each task before the
    exchange, then counted the same way, so a line that all documents have is a
    few numbers a task. Rows with a null doc_id are one document, before all others.
    """
    pairs = _long_lines(docs, min_chars).select("hash", "doc_id").distinct()
    counts = pairs.groupBy("hash").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
    return counts.where(F.col("n_docs") >= min_docs)


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, positions): the 0-based places of the lines to drop, for rows that have any.

    The table of common lines is stored first, so that the join meets two
    exchanges of its own and may split the rows of a very common line.
    """
    common = cut(common_lines(docs, min_docs, min_chars))
    lost = _long_lines(docs, min_chars).join(common, "hash").where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    return lost.groupBy("doc_id", "text_hash").agg(F.collect_set("position").alias("positions"))


def without_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Documents without the lines that ``min_docs`` documents or more share, but for the last document of each line.

    Columns as given, ``text`` being what stays, and ``n_lines`` (before
    dropping) and ``n_dropped`` in place of any of those names. A line's key is
    the line without white space at its ends, A-Z lower-cased; only keys of
    ``min_chars`` code points or more count. The document with the largest
    doc_id keeps all its lines of a key, repeated ones included.

    A null text stays null and is one empty line. Rows with a null doc_id are
    one document, before all others. Rows that repeat a doc_id are one document:
    a line of theirs counts once, and each row loses its own lines. Of a very
    long text one task holds the lines; a very common line is spread by the
    planner. No rows give no rows.
    """
    lost = dropped_lines(docs, min_docs, min_chars)
    lost = lost.select(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text"), "positions")
    # columns by their frame, not by name: the documents may have any others
    text, gone = docs["text"], lost["positions"]
    same = docs["doc_id"].eqNullSafe(lost["of_doc"]) & (F.xxhash64(text) == lost["of_text"])
    kept = F.filter(split_lines(text), lambda _, i: ~F.array_contains(gone, i))
    cleaned = F.when(gone.isNull(), text).otherwise(F.array_join(kept, "\n")).alias("text")
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return docs.join(lost, same, "left").select(
        *(cleaned if c == "text" else docs[f"`{c}`"] for c in names),
        F.size(split_lines(text)).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
    )
