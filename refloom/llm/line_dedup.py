"""Line dedup: lines that many documents share are dropped from all but one of them. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The bytes 0x20 and 0x09-0x0D.
BLANKS = " \t\n\x0b\x0c\r"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """text_hash tells rows apart that share an id, so that line positions belong to one text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return common.texts(docs, id_col, text_col).select("doc_id", F.xxhash64(text).alias("text_hash"), F.split(text, "\n", -1).alias("lines"))


def repeated_lines(rows: DataFrame, min_chars: int, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """(lines, repeated): each long line's key hash by document and position, and the keys that min_docs documents hold.

    A key is hashed to 128 bits. Lines are split and hashed once and kept in the shared folder, without their text. Documents are counted per key in two steps, by (key, document) and then by key with
    partial sums, so a line that a third of all documents hold is never gathered in one task.
    """
    key = common.lower_ascii(F.btrim(F.col("line"), F.lit(BLANKS)))
    lines = (
        rows.select("doc_id", "text_hash", F.posexplode("lines").alias("pos", "line"))
        .withColumn("key", key)
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("second"), "key").alias("k2"))
    )
    lines = common.write_shared(lines, "lines")
    repeated = (
        lines.select("k1", "k2", "doc_id")
        .distinct()
        .groupBy("k1", "k2")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
    )
    return lines, repeated


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drops each line whose key (blanks stripped at both ends, A-Z lower-cased) has at least min_chars code points and
    is found in at least min_docs documents, except in the largest id that holds it.

    Returns doc_id, n_lines, n_dropped, kept_text; one row per input row. Null and empty texts are one empty line. Rows
    that share an id are one document when documents are counted; a null id is one document, below all others, and keeps
    a line only if no other document holds it. A document that holds a line twice counts once and loses or keeps both.
    An empty table gives an empty table. Other columns are not read.

    Only the repeated keys and the positions of dropped lines are joined, so each text is shuffled once. In the join of lines with
    repeated keys, adaptive execution splits the partition of a line that very many documents hold.
    """
    rows = _rows(docs, id_col, text_col)
    lines, repeated = repeated_lines(rows, min_chars, min_docs)
    repeated = common.write_shared(repeated, "repeated-lines")
    drops = (
        lines.join(repeated.drop("n_docs"), ["k1", "k2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("drop_id"), F.col("text_hash").alias("drop_hash"))
        .agg(F.collect_set("pos").alias("drop"))
    )
    none = F.array().cast("array<int>")
    joined = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("drop_id")) & (F.col("text_hash") == F.col("drop_hash")), "left")
    drop = F.coalesce(F.col("drop"), none)
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), drop)
    return joined.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.size(drop).cast("long").alias("n_dropped"),
        F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n").alias("kept_text"),
    )
