"""Size-tiered compaction of immutable shards under a versioned manifest."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

#: Bytes that a compacted file aims at, runs of one tier that start a merge, and the ratio of two tiers.
TARGET_BYTES, FAN_IN, TIER_RATIO = 128 << 20, 4, 4
#: Commits that the arrivals of a table are dealt into, and shards of a table at least.
ARRIVALS, LEAST_SHARDS = 8, 16


@dataclass(frozen=True)
class Shard:
    """An immutable file of the store."""

    path: str
    bytes: int


class ConflictError(RuntimeError):
    """Another writer committed the version first."""


class Store:
    """A folder of Parquet shards and numbered manifests; a version is what its manifest lists.

    A manifest is written to a temporary file and published under its number, which fails if the number is taken: by a
    hard link in a local folder, by a rename elsewhere, which HDFS refuses atomically where the name exists. Shards that a
    manifest lists are never changed, and go only with `expire`; shards of a failed or lost commit are never listed.
    Rows are kept as they come: nulls, repeats and all columns stay. An empty arrival is a version without new rows.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join([self.root, *parts]))

    def _versions(self) -> list[int]:
        at = self._path("manifests")
        if not self._fs.exists(at):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        """The newest committed version; 0 is the empty store."""
        return max(self._versions(), default=0)

    def _manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        if v == 0:
            return {"shards": [], "schema": None}
        stream = self._fs.open(self._path("manifests", f"{v:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**s) for s in self._manifest(version)["shards"]]

    def commit(self, base: int, shards: list[Shard], schema: T.StructType | None = None) -> int:
        """Make shards version base + 1, or raise ConflictError if that version exists."""
        told = json.loads(schema.json()) if schema is not None else self._manifest(base)["schema"]
        text = json.dumps({"version": base + 1, "schema": told, "shards": [vars(s) for s in sorted(shards, key=lambda s: s.path)]})
        tmp, to = self._path("manifests", f".{uuid.uuid4().hex}"), self._path("manifests", f"{base + 1:010d}.json")
        self._fs.mkdirs(self._path("manifests"))
        out = self._fs.create(tmp, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not self._publish(tmp, to):
            self._fs.delete(tmp, False)
            raise ConflictError(f"version {base + 1} exists")
        return base + 1

    def _publish(self, tmp, to) -> bool:
        """Give the file tmp the name to, unless that name is taken."""
        if self._fs.getUri().getScheme() != "file":
            return self._fs.rename(tmp, to)
        at = lambda path: self.spark._jvm.java.io.File(path.toUri().getPath()).toPath()
        try:
            self.spark._jvm.java.nio.file.Files.createLink(at(to), at(tmp))
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        self._fs.delete(tmp, False)
        return True

    def _write(self, df: DataFrame, rows: int = 0) -> list[Shard]:
        """Write df's partitions as new files, of at most that many rows if any are given, and list them."""
        batch = uuid.uuid4().hex
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(f"{self.root}/shards/{batch}")
        found = self._fs.listStatus(self._path("shards", batch))
        return sorted((Shard(f"shards/{batch}/{f.getPath().getName()}", f.getLen()) for f in found if f.getPath().getName().startswith("part-")), key=lambda s: s.path)

    def append(self, df: DataFrame) -> int:
        """Add the partitions of df as small shards. Their sizes are whatever arrives."""
        base = self.version()
        return self.commit(base, self.shards(base) + self._write(df), df.schema)

    def append_all(self, df: DataFrame, commits: int = ARRIVALS) -> int:
        """Add df as arrivals of a few small shards each, one version after another.

        One pass over df writes all shards, each of about a quarter of the target over fan_in by the size that the planner
        knows, and LEAST_SHARDS of them at least; the commits then list them in turn.
        """
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        n = df.count()
        files = max(LEAST_SHARDS, -(-min(size, n << 20) * self.fan_in // self.target))
        shards = self._write(df, max(1, -(-n // files)))
        base = self.version()
        step = max(1, -(-len(shards) // commits))
        for i in range(0, max(len(shards), 1), step):
            base = self.commit(base, self.shards(base) + shards[i : i + step], df.schema)
        return base

    def tier(self, size: int) -> int:
        """Tier of a run: 0 for target-sized files and beyond, -1, -2 ... for files smaller by the ratio each."""
        return min(0, math.floor(math.log(max(size, 1) / self.target, TIER_RATIO) + 0.2))

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Groups to merge: of each tier below the target, runs in order of size, packed up to the target.

        A tier waits until it has fan_in runs; lists of paths and sizes only.
        """
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if (t := self.tier(s.bytes)) < 0:
                tiers.setdefault(t, []).append(s)
        out = []
        for t in sorted(tiers):
            runs = sorted(tiers[t], key=lambda s: (s.bytes, s.path))
            if len(runs) < self.fan_in:
                continue
            group: list[Shard] = []
            for s in runs:
                if group and sum(x.bytes for x in group) + s.bytes > 1.1 * self.target:
                    out.append(group)
                    group = []
                group.append(s)
            if len(group) > 1:
                out.append(group)
        return [g for g in out if len(g) > 1]

    def compact(self) -> int:
        """Merge similarly sized runs until no tier has fan_in of them; one commit for each level.

        The merges of a level are one Spark job: every group is one task that streams its files into
        one new file, without a shuffle. Merged files stay for the versions that list them, until these expire.
        """
        while groups := self.plan(self.shards(base := self.version())):
            merged: list[Shard] = []
            schema = T.StructType.fromJson(self._manifest(base)["schema"])
            for at in range(0, len(groups), 64):  # frames of one job
                made = None
                for g in groups[at : at + 64]:
                    one = self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in g]).coalesce(1)
                    made = one if made is None else made.unionByName(one)
                merged += self._write(made)
            gone = {s.path for g in groups for s in g}
            self.commit(base, [s for s in self.shards(base) if s.path not in gone] + merged)
        return self.version()

    def expire(self, keep: int = 1) -> int:
        """Drop all but the newest keep versions and the shards that only they list; how many files went.

        Shards that no manifest lists yet are left alone: their commit may be under way.
        """
        newest = self.version()
        old = [v for v in self._versions() if v <= newest - keep]
        listed = {s.path for v in self._versions() if v > newest - keep for s in self.shards(v)}
        gone = {s.path for v in old for s in self.shards(v)} - listed
        for v in old:
            self._fs.delete(self._path("manifests", f"{v:010d}.json"), False)
        for p in gone:
            self._fs.delete(self._path(p), False)
        return len(gone)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version with _shard, the path of their shard in the store; where the rows have a column of that name,
        the added one gets more underscores. A version without rows is an empty table; version 0 has no schema to read."""
        told = self._manifest(version)
        if told["schema"] is None:
            raise ValueError("the store is empty")
        schema = T.StructType.fromJson(told["schema"])
        if not told["shards"]:
            empty = self.spark.createDataFrame([], schema)
            return empty.withColumn(free_name(empty, "_shard"), F.lit(""))
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{s['path']}" for s in told["shards"]])
        return rows.withColumn(free_name(rows, "_shard"), F.regexp_extract(F.col("_metadata.file_path"), r"(shards/[^/]+/[^/]+)$", 1))


def compact_table(df: DataFrame, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> tuple[Store, int]:
    """A store under root to which df came in several arrivals, compacted, with its newest version alone."""
    store = Store(df.sparkSession, root, target_bytes, fan_in)
    store.append_all(df)
    version = store.compact()
    store.expire()
    return store, version
