"""Line dedup by overlapping windows of consecutive lines, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, own_ids


def line_windows(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc, pos, h1, h2) of every run of width consecutive lines of docs(doc, text); two 64-bit hashes name a window."""
    joined = f"array_join(slice(lines, p + 1, {width}), '\\n')"
    return (
        docs.select("doc", F.split(F.col("text").cast("string"), "\n", -1).alias("lines"))
        .where(F.size("lines") >= width)
        .select("doc", F.expr(f"explode(transform(sequence(0, size(lines) - {width}), p -> struct(p as pos, {joined} as w)))").alias("x"))
        .select("doc", "x.pos", F.xxhash64("x.w").alias("h1"), F.xxhash64(F.lit(1), "x.w").alias("h2"))
    )


def covered_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc, gone: sorted array of the line numbers that later occurrences cover), for the rows of docs(doc, text) that have any.

    The first occurrence of a window is the one with the smallest (doc, pos). The windows are
    written once; the counts aggregate partially, and the join back can be split where a
    window is hot.
    """
    w = cut(line_windows(docs.where("text is not null"), width), "windows")
    many = w.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc", "pos")).alias("first")).where("n > 1").drop("n")
    later = w.join(many, ["h1", "h2"]).where("not (doc = first.doc and pos = first.pos)")
    return later.groupBy("doc").agg(F.collect_set("pos").alias("at")).select(
        "doc", F.expr(f"array_sort(array_distinct(flatten(transform(at, p -> sequence(p, p + {width - 1})))))").alias("gone")
    )


def dedup_lines(docs: DataFrame, width: int = 3, n_lines: str = "_n_lines", n_removed: str = "_n_removed") -> DataFrame:
    """docs with _n_lines, _n_removed (or the names given) and text without the lines that later occurrences cover.

    Windows are judged on the input. Lines are what newlines part; a document of fewer than width
    lines has no window and stays as it is, as do null texts and rows with a null doc_id. Every row is a document of its
    own, in the order of doc_id; rows that repeat a doc_id come in the order of a hash of their texts, and of
    equal rows one keeps its lines. A first occurrence keeps its lines unless a later window covers them
    as well. An empty table gives no rows. Columns that docs has under the two names are replaced; all others stay.
    """
    docs = docs.drop(n_lines, n_removed)
    row, gone, lines = free_name(docs, "_row"), free_name(docs, "_gone"), free_name(docs, "_lines")
    known, _ = own_ids(docs, "doc_id", row, [F.xxhash64("text")])
    covered = covered_lines(known.where("doc_id is not null").select(F.col(row).alias("doc"), "text"), width).withColumnsRenamed({"doc": row, "gone": gone})
    kept = F.expr(f"array_join(transform(array_except(sequence(0, size({lines}) - 1), {gone}), i -> {lines}[i]), '\n')")
    return (
        known.join(covered, row, "left")
        .withColumn(lines, F.split(F.col("text").cast("string"), "\n", -1))
        .withColumn(n_lines, F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"))
        .withColumn(n_removed, F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long"))
        .withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept))
        .select(*docs.columns, n_lines, n_removed)
    )
