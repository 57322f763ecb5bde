"""What the training-data operators share: tables, the shared folder, batches and components."""

from __future__ import annotations

import contextlib
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def free_name(df: DataFrame, stem: str) -> str:
    """stem, with as many underscores before it as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session without one gets its own."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="cadentia-")
        _own[context.applicationId] = base
    return base.rstrip("/")


_scratch = threading.local()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[set[str]]:
    """Deletes, at its end, the tables that this thread wrote to the shared folder meanwhile, other than those whose paths are put into the set it gives."""
    outer, kept = getattr(_scratch, "paths", None), set()
    _scratch.paths = made = []
    try:
        yield kept
    finally:
        _scratch.paths = outer
        if outer is not None:
            outer.extend(p for p in made if p in kept)
        remove(spark, *[p for p in made if p not in kept])


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/cadentia/{label}-{uuid.uuid4().hex}"
    if getattr(_scratch, "paths", None) is not None:
        _scratch.paths.append(path)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._cadentia_path = path
    return back


def path_of(table: DataFrame) -> str | None:
    """Where cut() wrote a table; None for others."""
    return getattr(table, "_cadentia_path", None)


def remove(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete tables made by cut() that no later step reads."""
    for x in tables:
        if path := x if isinstance(x, str) else path_of(x):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def own_ids(df: DataFrame, id_col: str, name: str, ties: list[Column]) -> tuple[DataFrame, bool]:
    """(df with a long column name that is unique and never null, whether that is id_col itself).

    Where ids are null or repeat, the rows are written in the order of id_col (nulls last), then of ties, and
    numbered: equal rows are told apart, and a smaller id never gets a larger number.
    """
    ids = df.select(F.col(id_col).alias("x"))
    if ids.groupBy("x").count().where("x is null or count > 1").isEmpty():
        return df.withColumn(name, F.col(id_col).cast("long")), True
    place = free_name(df, "_place")
    order = [F.col(id_col).asc_nulls_last(), *ties, F.col(place)]  # the place parts equal rows, so that no partition holds them all
    ranged = df.withColumn(place, F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(ranged.drop(place).withColumn(name, F.monotonically_increasing_id()), "rows"), False


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def payloads(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def spans(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive slices of at most limit bytes, or of one longer text."""
    lo, size = 0, 0
    for i, x in enumerate(texts):
        if i > lo and size + len(x) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(x)
    if lo < len(texts):
        yield lo, len(texts)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of edges(src, dst: long) as (node, component = smallest node reachable).

    Alternates large-star and small-star contractions (Kiveris et al. 2014) until no edge changes.
    Each half is a partial aggregate and an equi-join, whose hot side adaptive execution can split;
    every round is cut to the shared folder. Nodes without an edge have no row.
    """
    spark = edges.sparkSession
    e = cut(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), label
    )
    mark = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == mark:
            break
        mark = now
        both = e.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(e.select(F.col("v").alias("n"), F.col("u").alias("m")))
        low = both.groupBy("n").agg(F.min("m").alias("lo"))
        large = both.where("m > n").join(low, "n").select(F.col("m").alias("u"), F.least("n", "lo").alias("v")).distinct()
        large = cut(large, label)
        low = large.groupBy("u").agg(F.min("v").alias("lo"))
        small = large.join(low, "u").where("v <> lo").select(F.col("v").alias("u"), F.col("lo").alias("v"))
        after = cut(small.unionByName(low.select("u", F.col("lo").alias("v"))).distinct(), label)
        remove(spark, e, large)
        e = after
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
